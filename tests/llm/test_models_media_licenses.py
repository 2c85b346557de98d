import hashlib
import zlib

import numpy as np

from tidemark.llm import langid, license_scan, media, quality

SF = "/root/testdata/sf0.01"


def test_language_on_held_out(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = langid.learn(d)
    rows = langid.identify(d, profiles, keep=("lang",)).where("held_out").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None, "x"), (2, "123 !?", "x"), (None, "the house", None)], "doc_id long, text string, score string")
    got = {r.doc_id: (r.lang_pred, r.held_out) for r in langid.identify(odd, profiles).collect()}
    assert got[1][0] == got[2][0] == "und" and got[None] == (got[None][0], False)
    assert langid.learn(d.limit(0)) == {} and langid.Profiles({}).predict("abc") == ("und", 0.0)


def test_quality_by_line_labels(spark):
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    field = quality.train(d, labels)
    rows = quality.label(d, field).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.25 * len(bad)
    assert quality.train(d, labels.limit(0)) is None and quality.label(d.limit(0), field).count() == 0


def test_base_rules():
    n, chars, symbols, dups, repeats, failed, kept, _ = quality.measure("a b c\na b c\n\n# x\x85y | a b c", None)
    assert (n, chars, symbols, dups, repeats) == (12, 14, 2, 1, 9) and failed and not kept
    assert quality.measure("", None)[:6] == (0, 0, 0, 0, 0, True)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(30):
        e, move, start = rng.normal(size=6), rng.normal(size=(2, 2)), rng.normal(size=2)

        def score(path, e=e, move=move, start=start):
            return start[path[0]] + sum(x for x, p in zip(e, path, strict=True) if p) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False))

        paths = [[k >> j & 1 for j in range(6)] for k in range(64)]
        assert quality.viterbi(e, move, start).tolist() == max(paths, key=score)


def test_media_round_trip(spark):
    rows = [(1, "héllo" * 30), (2, ""), (3, None), (4, "x" * 64), (5, "héllo" * 30), (None, "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS digest")
    got = {r.doc_id: r for r in media.media_columns(d).collect()}
    assert len(got) == 6
    for i, t in rows:
        payload = media.pad((t or "").encode())
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert got[i].media_sha256 == hashlib.sha256(media.png(payload)).hexdigest() and media.samples(media.png(payload)).tobytes() == payload
    assert got[1].feature == got[5].feature and media.media_columns(d.limit(0)).count() == 0


def test_pages_stay_in_order():
    html = '<p>One &amp; <b>two</b></p><script>no</script><figure><img src="sha256:ab" alt="old"><figcaption>The <i>cap</i></figcaption></figure>tail<img src="x.png" alt="a">'
    got = [(x["position"], x["kind"], x["text"], x["digest"], x["caption"]) for x in media.sequence(html)]
    assert got == [(0, "text", "One & two", None, None), (1, "media", "sha256:ab", "ab", "The cap"), (2, "text", "tail", None, None), (3, "media", "x.png", None, "a")]
    assert media.sequence(None) == []


def test_licenses_against_brute_force(spark):
    filler = " ".join(f"w{k}" for k in range(300))
    mit = license_scan.LICENSES[0].text
    rows = [(1, None), (2, ""), (3, f"{filler} MIT\nLicense {filler} the Apache-License, mit license"), (4, f"{filler} {mit[20:]}"), (5, "cc by " * 300), (5, "cc by " * 300), (6, "mıt license CC BYE"), (7, "GNU General Public License"), (None, "mit license")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS label", "1 AS score")
    got = license_scan.scan(d).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    phrases = {t.label: license_scan.words_of(t.text) for t in license_scan.PHRASES}
    for i, t in rows:
        w = license_scan.words_of(t or "")
        places = [(k, n) for n, p in phrases.items() for k in range(len(w)) if w[k : k + len(p)] == p]
        r = by[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({n for _, n in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
    assert by[4].labels == "mit-text" and 0.8 <= by[4].score < 1 and by[3].base_labels == "apache,mit" and by[5].n_base == 300
    # Every block at the threshold is found.
    templates = license_scan.LICENSES[:3]
    sample = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(200).unionByName(d.select("doc_id", "text"))
    found = {(r.text_hash, r.block, r.label) for r in license_scan.block_matches(sample, templates).collect()}
    from pyspark.sql import functions as F

    for r in sample.select("text", F.xxhash64("text").alias("h")).collect():
        w = license_scan.words_of(r.text or "")
        for k in range(0, len(w), license_scan.STRIDE):
            block = set(w[k : k + 2 * license_scan.STRIDE])
            for t in templates:
                s = set(license_scan.words_of(t.text))
                assert (len(s & block) >= t.threshold * len(s)) == ((r.h, k // license_scan.STRIDE, t.label) in found)
    assert license_scan.scan(d.limit(0)).count() == 0
