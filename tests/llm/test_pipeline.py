from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from assay.llm import jaccard, queries, shared


def test_stages_keep_columns_and_drop_what_they_should(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, sf_dir))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        sizes.append(docs.count())
        if name == "exact_dedup":
            assert docs.count() == docs.select("text").distinct().count()
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_stages_take_null_ids_and_texts(spark, sf_dir):
    rows = [(1, "the same text of some words", "en", "s", 1), (2, "the same text of some words", "en", "s", 1), (None, None, None, None, None), (None, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, sf_dir))
    assert sorted(r["doc_id"] for r in docs.where("doc_id is not null").collect()) == [2]
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(0), sf_dir).count()


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    rows = [(k, f"text number {k} of a few words", "en", "s", 1, 7, 8) for k in range(3)] + [(9, "text number 0 of a few words", "en", "s", 1, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, _ROW int")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, sf_dir))
        assert docs.columns[-2:] == ["row", "_ROW"], name
    assert {(r["row"], r["_ROW"]) for r in docs.collect()} == {(7, 8)} and docs.count() == 3


@pytest.mark.parametrize("most", [1 << 22, 0])
def test_near_copies_of_the_given_documents_are_those_of_all_pairs(spark, monkeypatch, most):
    """Recall 1.0 on the table of 1,000 documents, by either way that dropped rows reach theirs."""
    small = shared.small_side
    for module in (corpus_pipeline, jaccard):
        monkeypatch.setattr(module, "small_side", lambda keys: small(keys, most))
    given = "/root/testdata/sf0.01"
    docs = corpus_pipeline.cut(corpus_pipeline.drop_copies(spark, spark.read.parquet(f"{given}/documents.parquet"), given))
    rows = sorted((r["doc_id"], (r["text"] or "").encode().lower().split()) for r in docs.collect())
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for _, w in rows]
    where, shared_by = defaultdict(list), Counter()
    for k, own in enumerate(sets):
        for x in own:
            for j in where[x]:
                shared_by[j, k] += 1
            where[x].append(k)
    group = list(range(len(rows)))
    for (j, k), n in shared_by.items():
        if 10 * n >= 8 * (len(sets[j]) + len(sets[k]) - n) and group[j] != group[k]:
            a, b = sorted((group[j], group[k]))
            group = [a if g == b else g for g in group]
    empty = [k for k, own in enumerate(sets) if not own]
    wanted = {rows[g][0] for k, g in enumerate(group) if k not in empty[1:]}
    found = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, given).collect()}
    assert found == wanted and len(found) < len(rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r)) for r in df.select(columns).collect())
