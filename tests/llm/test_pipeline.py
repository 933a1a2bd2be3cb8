"""The pipeline's stages against plain rules on a small fixture."""

import corpus_pipeline

from tests.llm.test_edge_cases import BASE, edited, text



def test_stages(spark, tmp_path):
    bench = text(500, 30)
    good = [(i, f"{text(i, 120)}", "en", "s", 1) for i in range(40)]
    bad = [(100 + i, " ".join(f"{w}$$$" for w in text(100 + i, 120).split()), "en", "s", 1) for i in range(40)]
    rows = good + bad + [(200, None, "en", "s", 1), (201, "123 !!", None, "s", 1), (202, BASE, "en", "s", 1), (203, edited(BASE, 2, 1), "en", "s", 1), (204, f"{text(600, 60)} {bench} {text(601, 60)}", "en", "s", 1), (None, text(700, 80), "en", "s", 1)]
    cols = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 100), 0) for r in good + bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append({r.doc_id for r in docs.collect()})
    everything = {r[0] for r in rows}
    assert kept[0] == everything - {200, 201}
    assert kept[1] & {r[0] for r in good} == {r[0] for r in good} and not kept[1] & {r[0] for r in bad}
    assert 202 in kept[2] and 203 not in kept[2] and kept[2] == kept[1] - {203}
    assert kept[3] == kept[2] - {204}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").collect()} == kept[3]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_id_and_repeated_ids(spark, tmp_path):
    """Decisions are by row: an id decides neither for another text of the same id nor for rows without id."""
    bench = text(500, 30)
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean, dirty, other = text(700, 80), f"{text(600, 60)} {bench} {text(601, 60)}", text(900, 70)
    cols = "doc_id long, text string, row string, key int, id int, h1 int"
    docs = spark.createDataFrame([(i, t, "r", 1, 2, 3) for i, t in [(None, clean), (None, dirty), (1, clean), (2, dirty), (2, other), (2, other)]], cols)
    got = corpus_pipeline.benchmark(spark, docs, str(tmp_path))
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    assert got.columns == docs.columns and rows(got) == sorted([(1, clean), (None, clean), (2, other), (2, other)], key=repr)
    near = edited(clean, 2, 1)
    docs = spark.createDataFrame([(i, t, "r", 1, 2, 3) for i, t in [(None, near), (None, near), (5, clean), (5, other), (5, other), (4, near), (None, dirty), (None, dirty), (6, other)]], cols)
    got = corpus_pipeline.duplicates(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and rows(got) == sorted([(4, near), (5, other), (None, dirty)], key=repr)
