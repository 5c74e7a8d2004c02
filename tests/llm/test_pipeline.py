"""The pipeline's stages, and each stage's effect on rows made for it."""

import collections

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and 0 < docs.count() <= before, name
            before = docs.count()
    rows = docs.collect()
    assert len({r["doc_id"] for r in rows}) == before
    used = collections.Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 4096


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", "a", 1), (2, text, "en", "a", 1), (2, text, "en", "a", 1), (3, "else " + text.upper(), "en", "a", 1), (4, None, None, None, None), (None, text, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r["doc_id"] for r in corpus_pipeline.STAGES[2][1](spark, docs, FOLDER).collect()]
    assert sorted(kept, key=str) == [1, 4, None]


def test_near_duplicate_stage_links_pairs_from_80_percent(spark):
    """Two scattered changes in 100 words: 86 of 106 shingles are shared (0.81)."""
    from sparkloom.llm import neardup

    base = [f"w{i}" for i in range(100)]
    near = ["x" if i in (30, 60) else w for i, w in enumerate(base)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near))], "doc_id long, text string")
    assert [r["doc_id"] for r in neardup.stage(spark, docs, FOLDER).collect()] == [1]
    assert neardup.near_duplicates(docs, 85).filter("kept").count() == 2
    assert [(1 - (p / 100) ** 5) ** neardup.bands_for(p) <= 1e-6 for p in (80, 85, 90)] == [True] * 3


def test_near_duplicates_keep_the_texts_of_repeated_ids_apart(spark):
    """Id 1 has two texts; each finds its near copy, and the stage keeps one row of both groups."""
    from sparkloom.llm import neardup

    texts = {k: [f"{k}{i}" for i in range(120)] for k in "ab"}
    changed = lambda k: " ".join(["changed", *texts[k][1:]])
    rows = [(1, " ".join(texts["a"])), (1, " ".join(texts["b"])), (2, changed("a")), (3, changed("b")), (4, "some other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, 85).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]
    kept = neardup.stage(spark, docs, FOLDER).collect()
    assert sorted((r["doc_id"], r["text"][0]) for r in kept) == [(1, "a"), (1, "b"), (4, "s")]


def test_stages_take_empty_tables_and_odd_rows(spark):
    """No rows; nulls in every column, empty texts, repeated rows and columns whose names clash with those of the stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, tokens long, weight string"
    empty = spark.createDataFrame([], schema)
    prose = " ".join(f"word{i}" for i in range(90)) + "."
    odd = [(None, None, None, None, None, None, None, None, None), (1, "", "en", "a", 0, True, 0.5, 1, "x"), (1, prose, None, "a", 0, None, 0.5, 1, "x"), (1, prose, None, "a", 0, None, 0.5, 1, "x"),
           (2, prose.upper(), "en", None, 0, False, None, None, None), (None, prose + " more", "en", "b", 1, True, 1.0, 2, "y")]
    rows = spark.createDataFrame(odd, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, FOLDER)
        assert out.columns == empty.columns and out.count() == 0, name
        out = stage(spark, rows, FOLDER)
        assert out.columns == rows.columns and out.count() <= len(odd), name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, FOLDER).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, rows, FOLDER).filter("start = 0").count() == len(odd)
