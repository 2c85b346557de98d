import random

import pytest

import corpus_pipeline
from tests.llm.test_dedup import rows_by_text
from tests.llm.test_partenum import brute
from tidemark.llm.common import checkpointed

SF = "/root/testdata/sf0.001"


def stages(spark, docs, upto=5):
    """The result of each stage, written and read as the next one's input."""
    out = []
    for _, stage in corpus_pipeline.STAGES[:upto]:
        docs = checkpointed(stage(spark, docs, SF))
        out.append(docs)
    return out


@pytest.fixture(scope="module")
def prose(spark):
    """Words of clean documents."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").orderBy("doc_id").select("text").collect()
    return sorted({w for r in rows if r.text for w in r.text.split() if w.isalpha()})


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "jaccard_join", "substring_dedup", "best_fit_packing"]
    *kept, packed = stages(spark, docs)
    for (name, _), rows in zip(corpus_pipeline.STAGES, kept, strict=False):
        left = {r.doc_id for r in rows.select("doc_id").collect()}
        assert rows.columns == columns and left <= ids and (left == ids if name == "substring_dedup" else True)
        ids = left
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
    assert sorted(map(tuple, packed.select("doc_id", "piece", "length").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length").collect()))


def test_planted_cases(spark, prose):
    """Each stage against what plain Python does with its input."""
    rng = random.Random(7)
    text = lambda n: ". ".join(" ".join(rng.choice(prose) for _ in range(12)) for _ in range(n // 12)) + "."
    clean = [(k, text(180)) for k in range(1, 13)]
    passage = text(72)
    rows = [*clean, (101, clean[0][1]), (102, clean[1][1].replace(clean[1][1].split()[20], "changed", 1)), (103, text(120) + " " + passage), (104, passage + " " + text(120)), (105, "too short"), (106, None), (107, ""), (108, "# # # | | | $$$ ### |||" * 40), (None, text(150)), (None, text(150)), (1, clean[0][1]), (1, text(160))]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or ""), k, None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, whole_row_ int, `a b` string")
    good, known, single, cut, packed = stages(spark, docs)
    pairs = lambda d: sorted((str(r.doc_id), r.text) for r in d.select("doc_id", "text").collect())
    assert good.columns == known.columns == single.columns == cut.columns == docs.columns
    bad = {"105", "106", "107", "108"}
    assert pairs(good) == pairs(known) == sorted((str(i), t) for i, t in rows if str(i) not in bad)
    # One row of each component; brute() knows rows by a number, so that those with the same id stay apart.
    left = [(k, i, t) for k, (i, t) in enumerate(rows) if str(i) not in bad]
    groups = {}
    for k, i, t in left:
        groups.setdefault(brute([(a, b) for a, _, b in left])[0][k][1], []).append((i if i is not None else 1 << 62, t))
    kept = pairs(single)
    assert len(kept) == len(groups) and all(min(g)[0] in {int(i) if i != "None" else 1 << 62 for i, t in kept if t in {t for _, t in g}} for g in groups.values())
    expected = rows_by_text([(None if i == "None" else int(i), t) for i, t in kept], 50, True)
    assert [len(t.split()) for _, t in pairs(cut)] == [len(t.split()) - n for (_, t), (_, n, _) in zip(kept, sorted(expected, key=lambda r: r[0]), strict=True)] if len({i for i, _ in kept}) == len(kept) else True
    assert passage in {t for i, t in pairs(cut) if i == "103"}.pop() and passage not in {t for i, t in pairs(cut) if i == "104"}.pop()
    assert sorted({(str(r.doc_id)) for r in packed.collect()}) == sorted({i for i, _ in kept})


def test_empty_table_and_odd_columns(spark, prose):
    docs = spark.createDataFrame([(1, " ".join(prose[:200]), 1, 2, 3, None)], "doc_id int, text string, row int, rest int, marked_ int, runs array<int>")
    *some, packed = stages(spark, docs)
    assert all(d.columns == docs.columns and d.count() == 1 for d in some) and packed.count() >= 1
    *none, packed = stages(spark, docs.limit(0))
    assert all(d.columns == docs.columns and not d.count() for d in none) and not packed.count()


def test_a_very_long_text(spark, prose):
    rng = random.Random(3)
    long = ". ".join(" ".join(rng.choice(prose) for _ in range(15)) for _ in range(8000))
    docs = spark.createDataFrame([(1, long), (2, long + " more")], "doc_id long, text string")
    *kept, packed = stages(spark, docs)
    assert [d.count() for d in kept] == [2, 2, 1, 1] and packed.count() == -(-packed.agg({"length": "sum"}).first()[0] // 4096)
