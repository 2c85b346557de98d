import hashlib
import random
from collections import defaultdict

import pytest

from tidemark.llm import fm_dedup, suffix_dedup


def brute_words(rows, w):
    least = {}
    for i, t in rows:
        x = (t or "").encode().split()
        for k in range(len(x) - w + 1):
            s = b" ".join(x[k : k + w])
            least[s] = min(least.get(s, i), i)
    out = {}
    for i, t in rows:
        x = (t or "").encode().split()
        gone = [False] * len(x)
        for k in range(len(x) - w + 1):
            if least[b" ".join(x[k : k + w])] < i:
                gone[k : k + w] = [True] * w
        out[i] = (len(x), sum(gone), hashlib.sha256(b" ".join(a for a, g in zip(x, gone, strict=True) if not g)).hexdigest())
    return out


def brute_bytes(rows, w):
    count = defaultdict(int)
    for _, t in rows:
        x = (t or "").encode()
        for k in range(len(x) - w + 1):
            count[x[k : k + w]] += 1
    out = {}
    for i, t in rows:
        x = (t or "").encode()
        gone = bytearray(len(x))
        for k in range(len(x) - w + 1):
            if count[x[k : k + w]] > 1:
                gone[k : k + w] = b"\1" * w
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(x), sum(gone), spans, hashlib.sha256(bytes(a for a, g in zip(x, gone, strict=True) if not g)).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)

    def words(n):
        return [rng.choice("the of and a to in is it on by".split()) if rng.random() < 0.2 else "".join(rng.choice("abcdeéf") for _ in range(5)) for _ in range(n)]

    passages, rows = [words(rng.randint(40, 140)) for _ in range(6)], []
    for i in range(120):
        r = rng.random()
        if r < 0.1:
            x = ["the"] * rng.randint(1, 300)
        elif r < 0.3 and rows:
            x = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 4) if x else 0):
                x[rng.randrange(len(x))] = rng.choice(["zz", "yy", "xx"])
        else:
            x = words(rng.randint(0, 60))
            for _ in range(rng.randint(0, 3)):
                p = rng.choice(passages)
                x += p[rng.randint(0, 10) : len(p) - rng.randint(0, 10)] + words(rng.randint(0, 30))
        rows.append((i * 7 % 1000, " ".join(x)))
    return [*rows, (5000, None), (5001, "")]


@pytest.mark.parametrize(("seed", "block"), [(3, 1024), (4, 2)])
def test_against_brute_force(spark, seed, block):
    rows = corpus(seed)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in fm_dedup.digests(fm_dedup.dedup(d, block=block)).collect()}
    assert got == brute_words(rows, 50)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(suffix_dedup.dedup(d, block=block)).collect()}
    assert got == brute_bytes(rows, 400)


def test_fm_index_and_doubling_alone():
    rng = random.Random(1)
    data = [" ".join(rng.choice("abc") for _ in range(rng.randint(6, 20))).encode() for _ in range(12)]
    owners = [rng.randrange(6) for _ in data]
    for w in (4, 6):
        for d, o, flags in zip(data, owners, fm_dedup.earlier_windows(data, owners, w), strict=True):
            x = d.split(b" ")
            for k in range(len(x) - w + 1):
                there = any(p < o and any(y[j : j + w] == x[k : k + w] for j in range(len(y) - w + 1)) for p, y in ((p, e.split(b" ")) for p, e in zip(owners, data, strict=True)))
                assert bool(flags[k]) == there
    count = defaultdict(int)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(8, 30))) for _ in range(15)]
    for t in texts:
        for k in range(len(t) - 7):
            count[t[k : k + 8]] += 1
    for t, flags in zip(texts, suffix_dedup.repeated_windows(texts, 8), strict=True):
        assert flags.tolist() == [count[t[k : k + 8]] > 1 for k in range(len(t) - 7)]


def test_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(80))
    d = spark.createDataFrame([(1, text, 1), (1, text, 2), (2, text, 3), (None, text, 4), (3, None, 5)], "doc_id long, text string, runs int")
    got = sorted((r.doc_id or 99, r.n_words, r.n_removed) for r in fm_dedup.digests(fm_dedup.dedup(d)).collect())
    assert got == [(1, 80, 0), (1, 80, 0), (2, 80, 80), (3, 0, 0), (99, 80, 80)]
    assert {r.doc_id: r.text for r in fm_dedup.clean(d).where("doc_id > 1").collect()} == {2: "", 3: None} and fm_dedup.clean(d).columns == d.columns
    assert fm_dedup.digests(fm_dedup.dedup(d.limit(0))).count() == 0 and suffix_dedup.digests(suffix_dedup.dedup(d.limit(0))).count() == 0


def rows_by_text(rows, w, across):
    """(doc_id, text, removed symbols, kept) of each row: brute force in which every row stands for itself; null is greatest."""
    split = str.split if across else str.encode
    where = defaultdict(list)
    for i, t in rows:
        x = split(t)
        for k in range(len(x) - w + 1):
            where[tuple(x[k : k + w])].append(float("inf") if i is None else i)
    out = []
    for i, t in rows:
        x = split(t)
        gone = [False] * len(x)
        for k in range(len(x) - w + 1):
            at = where[tuple(x[k : k + w])]
            if min(at) < (float("inf") if i is None else i) if across else len(at) > 1:
                gone[k : k + w] = [True] * w
        kept = [a for a, g in zip(x, gone, strict=True) if not g]
        out.append((str(i), sum(gone), hashlib.sha256(" ".join(kept).encode() if across else bytes(kept)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 2])
def test_rows_that_share_an_id_or_have_none(spark, block):
    def words(name, n):
        return " ".join(f"{name}{k}" for k in range(n))

    rng = random.Random(5)
    rows = [(1, words("p", 100)), (None, words("p", 100) + " " + words("a", 60)), (None, words("b", 100)), (7, words("c", 120)), (7, words("p", 100)), (7, words("d", 130)), (7, words("d", 130))]
    rows += [(rng.choice([None, 3, 4, 900]), t) for _, t in corpus(6) if t]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = fm_dedup.digests(fm_dedup.dedup(d, block=block)).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.kept_sha256) for r in got) == rows_by_text(rows, 50, True)
    got = suffix_dedup.digests(suffix_dedup.dedup(d, block=block)).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.kept_sha256) for r in got) == rows_by_text(rows, 400, False)
    # In the pipeline no row may lose words that stand nowhere else.
    assert words("b", 100) in [r.text for r in fm_dedup.clean(d).where("doc_id is null").collect()]


def test_what_blocks_share_takes_few_rows(spark, monkeypatch):
    """Near copies make one key of many contents: blocks are compared by fewer rows than they have windows."""
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh") for _ in range(900))
    rows = []
    for i in range(90):
        x = list(text)
        x[rng.randrange(900)] = "XYZ"[i % 3]
        rows.append((i, "".join(x)))
    made, windows = [], []
    plain, checkpointed = suffix_dedup.resolve_blocks, suffix_dedup.checkpointed

    def noted(df):
        out = checkpointed(df)
        made.append(out.count() if "k1" in out.columns and "n" not in out.columns else 0)
        return out

    def seen(found, w=400):
        windows.extend(len(r.data) - w + 1 for r in found.collect())
        monkeypatch.setattr(suffix_dedup, "checkpointed", noted)
        out = plain(found, w)
        monkeypatch.setattr(suffix_dedup, "checkpointed", checkpointed)
        return out

    monkeypatch.setattr(suffix_dedup, "resolve_blocks", seen)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(suffix_dedup.dedup(d, block=8)).collect()}
    assert got == brute_bytes(rows, 400)
    assert windows and 0 < sum(made) < sum(windows) / 3
