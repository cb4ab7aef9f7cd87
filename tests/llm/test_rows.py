import corpus_pipeline
from tests.llm.cases import prose


def test_stages_judge_each_row_by_itself(spark, sf_dir):
    item = max((r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()), key=len)
    a, b, c = (" ".join(f"{w}{k}{i % 89}" for i, w in enumerate(prose(k, 300).split())) for k in range(3))
    rows = [(None, a), (None, a), (None, a + " end"), (1, b), (1, b), (2, b), (2, c), (None, item), (3, item), (3, c + " x y z")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = corpus_pipeline.cut(corpus_pipeline.drop_copies(spark, docs, sf_dir))
    as_list = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    wanted = [(None, a), (None, a + " end"), (2, b), (2, c), (3, item), (3, c + " x y z")]
    assert as_list(left) == sorted(wanted, key=str)
    left = corpus_pipeline.cut(corpus_pipeline.drop_near_copies(spark, left, sf_dir))
    first = [t for i, t in as_list(left) if i is None]
    assert len(first) == 1 and first[0] in (a, a + " end")
    assert sorted((x for x in as_list(left) if x[0]), key=str) == sorted([(2, b), (2, c), (3, item)], key=str)
    left = corpus_pipeline.drop_benchmark(spark, left, sf_dir)
    assert sorted(i or 0 for i, _ in as_list(left)) == [0, 2, 2]
    both = spark.createDataFrame([(None, item, "en", "s", 0), (7, item, "en", "s", 0), (7, c, "en", "s", 0)], docs.schema)
    assert as_list(corpus_pipeline.drop_benchmark(spark, both, sf_dir)) == [(7, c)]
