import random

import numpy as np

from tidemark.llm import partenum


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent, ids, links = {i: i for i in sets}, sorted(sets), []
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a > b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                links.append((a, b))
                p, q = find(parent, a), find(parent, b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(parent, i)) for i in sets}, links


def corpus(seed, n=400):
    rng, rows = random.Random(seed), []
    common = ["".join(rng.choice("abcdef") for _ in range(3)) for _ in range(60)]
    for i in range(n):
        if rows and rng.random() < 0.7:
            x = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6])):
                if x:
                    k, c = rng.randrange(len(x)), rng.random()
                    if c < 0.5:
                        x[k] = "zz"
                    elif c < 0.75:
                        x.insert(k, "qq")
                    else:
                        del x[k : k + rng.randint(1, 3)]
        else:
            x = ["".join(rng.choice("abcdef") for _ in range(3)) for _ in range(rng.choice([0, 1, 3, 5, 6, 8, 9, 10, 12, 20, 40, 60, 100, 150, 300]))]
            if rng.random() < 0.5:
                x += common
        rows.append((i * 7 % 1000, " ".join(x)))
    return [*rows, (5000, None), (5001, ""), (5002, "Only Four words here"), (5003, "only four WORDS here")]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(partenum, "HOT_LEAST", 4)
    rows = corpus(3)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.join(d).collect()}
    assert got == brute(rows)[0]


def test_all_similar_pairs_share_a_signature():
    rows = dict(corpus(5, 250))
    x = {i: partenum.shingles(t) for i, t in rows.items()}
    values, counts = np.unique(np.concatenate(list(x.values())), return_counts=True)
    hot = values[counts >= 5]
    signed = {i: set(partenum.signatures(s, hot).tolist()) for i, s in x.items()}
    links = brute(list(rows.items()))[1]
    assert links and all(signed[a] & signed[b] for a, b in links)


def test_blocks_find_all_links():
    rng = random.Random(1)
    for t in range(100):
        base = [rng.randrange(60) for _ in range(20)]
        s = [np.unique(np.array([b for b in base if rng.random() < 0.9] + [rng.randrange(60) for _ in range(rng.randint(0, 3))], np.uint64)) for _ in range(rng.randint(2, 12))]
        side = np.array([rng.randint(0, 1) for _ in s]) if t % 2 else np.zeros(len(s), int)
        if t % 2 and len(set(side)) < 2:
            continue
        one, two = list(range(len(s))), list(range(len(s)))
        for a, b in partenum.similar(one, s, side):
            two[find(two, a)] = find(two, b)
        one = list(range(len(s)))
        for i in range(len(s)):
            for j in range(i):
                c = len(np.intersect1d(s[i], s[j]))
                if (not side.any() or side[i] != side[j]) and 100 * c >= 80 * (len(s[i]) + len(s[j]) - c):
                    one[find(one, i)] = find(one, j)
        assert all((find(one, i) == find(one, j)) == (find(two, i) == find(two, j)) for i in range(len(s)) for j in range(len(s)))


def test_components_and_odd_rows(spark):
    e = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (9, 8), (5, 9), (7, 7)], "u long, v long")
    assert {(r.node, r.root) for r in partenum.components(e).collect()} == {(2, 1), (3, 1), (4, 1), (8, 5), (9, 5)}
    d = spark.createDataFrame([(4, "a b c d e f", 0), (4, "a b c d e f", 1), (None, "a b c d e f", 2), (6, None, 3), (7, None, 4)], "doc_id long, text string, root int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in partenum.join(d).collect())
    assert got == [(0, 2, 4), (4, 2, 4), (4, 2, 4), (6, 0, 6), (7, 0, 7)]
    assert partenum.join(d.limit(0)).count() == 0


def test_a_row_without_id_passes_links_on(spark):
    words = [f"w{k}" for k in range(60)]
    near = lambda *at: " ".join("x" if k in at else w for k, w in enumerate(words))
    d = spark.createDataFrame([(1, near(3)), (None, near()), (2, near(50)), (3, "else " * 9), (None, "alone and with no other document")], "doc_id long, text string")
    links = brute([(r.doc_id or 9, r.text) for r in d.collect()[:3]])[1]
    assert sorted(links) == [(9, 1), (9, 2)]  # 1 and 2 are linked by the row without an id alone
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in partenum.join(d).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (2, 1), (3, 3)]
    assert sorted((r.doc_id or 0, r.text[:2]) for r in partenum.keep_one(d).collect()) == [(0, "al"), (1, "w0"), (3, "el")]


def test_small_blocks_and_long_texts(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(9000)}" for _ in range(4000)]
    rows = [(k, " ".join(base[: 4000 - 40 * k])) for k in range(12)] + [(100 + k, " ".join(base[:300] + [f"v{k}"])) for k in range(9)] + [(300, " ".join(base * 12))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    members = partenum.checkpointed(partenum.sets(partenum.identified(d))).where("hot is null")
    nodes = members.select("node").distinct().collect()
    edges = spark.createDataFrame([(r.node, nodes[0].node) for r in nodes[1:]], "node long, root long")
    # One candidate component of all sets, compared whole and by blocks of three sets or few shingles.
    for block, elements in ((2048, 10**6), (3, 10**6), (100, 5000)):
        links = partenum.components(partenum.verified(partenum.identified(d), members, edges, block=block, elements=elements))
        root = {bytes(r.node): bytes(r.root) for r in links.collect()}
        by_id = {r.doc_id: root.get(bytes(r.set_key), bytes(r.set_key)) for r in members.collect()}
        expected = {i: c for i, (_, c) in brute(rows)[0].items()}
        assert {(a, b) for a in by_id for b in by_id if by_id[a] == by_id[b]} == {(a, b) for a in expected for b in expected if expected[a] == expected[b]}


def test_shared_counts():
    rng = np.random.default_rng(4)
    for n, width, p in ((40, 30, 0.5), (60, 400, 0.05), (80, 50, 0.9)):
        m = rng.random((n, width)) < p
        row, column = np.nonzero(m)
        left, right = np.arange(0, n, 2), np.arange(1, n, 2)
        x = m.astype(int)
        assert (partenum.shared(row, column, left, right) == x[left] @ x[right].T).all()


def test_shared_passages_do_not_chain_unrelated_sets(spark, monkeypatch):
    """Texts that have passages in common with the next ones, and no more, aren't candidates; near copies and copies are."""
    rng = random.Random(9)
    passages = [[f"p{k}w{j}" for j in range(20)] for k in range(61)]
    rows = [(k, " ".join([*passages[k], *(f"d{rng.randrange(10**9)}" for _ in range(400)), *passages[k + 1]])) for k in range(60)]
    rows += [(100 + k, rows[k][1] + " more") for k in range(5)] + [(200, rows[7][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    signed, edges = [], partenum.candidate_edges

    def counted(x, *more):
        signed.extend(r.doc_id for r in x.select("doc_id").collect())
        return edges(x, *more)

    monkeypatch.setattr(partenum, "candidate_edges", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.join(d).collect()}
    assert got == brute(rows)[0]
    assert set(range(5)) | {100 + k for k in range(5)} <= set(signed) <= set(range(5)) | {100 + k for k in range(5)} | {7, 200}


def test_partnered_keeps_all_that_link(spark, monkeypatch):
    monkeypatch.setattr(partenum, "HELD", 3000)
    rows = corpus(11)
    d = partenum.identified(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    sets = {i: partenum.set_key(partenum.shingles(t)) for i, t in rows}
    stay = {sets[r.doc_id] for r in partenum.partnered(d).collect()}
    links = brute(rows)[1]
    assert len(links) > 50 and all(sets[a] in stay and sets[b] in stay for a, b in links if sets[a] != sets[b])


def test_keep_one_signs_only_sets_with_a_chance(spark, monkeypatch):
    rows = [(k, " ".join([*(f"p{j}" for j in range(20)), *(f"d{k}w{j}" for j in range(400))])) for k in range(20)]
    rows.append((100, rows[3][1] + " more"))
    signed, edges = [], partenum.candidate_edges

    def counted(x, *more):
        signed.extend(r.doc_id for r in x.select("doc_id").collect())
        return edges(x, *more)

    monkeypatch.setattr(partenum, "candidate_edges", counted)
    kept = partenum.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20)) and sorted(signed) == [3, 100]


def test_rounds_bound_what_the_exact_join_deals_out(spark, monkeypatch):
    """A component of 20 blocks has every text in 20 pairs of blocks: all are compared, but few at a time."""
    rng = random.Random(12)
    rows = []
    for k in range(80):
        x = rows[-1][1].split() if k % 4 else [f"w{rng.randrange(9000)}" for _ in range(100)]
        x[rng.randrange(100)] = f"v{k}"
        rows.append((k, " ".join(x)))
    d = partenum.identified(spark.createDataFrame(rows, "doc_id long, text string"))
    members = partenum.checkpointed(partenum.sets(d)).where("hot is null")
    nodes = members.select("node").distinct().collect()
    edges = spark.createDataFrame([(r.node, nodes[0].node) for r in nodes[1:]], "node long, root long")
    dealt, run = [], partenum.map_arrow

    def counted(x, *more):
        if "side" in x.columns:
            dealt.append(x.count())
        return run(x, *more)

    monkeypatch.setattr(partenum, "map_arrow", counted)
    links = partenum.components(partenum.verified(d, members, edges, block=4)).collect()
    root = {bytes(r.node): bytes(r.root) for r in links}
    by_id = {r.doc_id: root.get(bytes(r.set_key), bytes(r.set_key)) for r in members.collect()}
    expected = {i: c for i, (_, c) in brute(rows)[0].items()}
    assert {(a, b) for a in by_id for b in by_id if by_id[a] == by_id[b]} == {(a, b) for a in expected for b in expected if expected[a] == expected[b]}
    assert sum(dealt) == 80 * 20 and max(dealt) <= 3 * 80
