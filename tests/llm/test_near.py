import random

from pyspark.sql import functions as F

import corpus_pipeline
from assay.llm import jaccard, simhash
from tests.llm.cases import prose


def sets(t, shingle=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()


def near(x, y):
    return x == y or 10 * len(x & y) >= 8 * len(x | y)


def edited(seed, words, n):
    r, w = random.Random(seed), list(words)
    for i in r.sample(range(len(w)), n):
        w[i] = f"w{seed}x{i}"
    return w


def wanted(rows):
    """The row of smallest doc_id of each group, by all pairs."""
    group, s = list(range(len(rows))), [sets(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and near(s[i], s[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for g, (d, _) in zip(group, rows):
        least[g] = min(least.get(g, (True, 0)), (d is None, d or 0))
    return sorted(least.values())


def test_near_stage_drops_copies_of_similarity_from_08(spark, sf_dir):
    words = [prose(k, 400).split() for k in range(12)]
    words = [[f"{x}{k}{i % 97}" for i, x in enumerate(w)] for k, w in enumerate(words)]
    rows = [(10 * k, " ".join(w)) for k, w in enumerate(words)]
    rows += [(10 * k + n, " ".join(edited(100 * k + n, w, n))) for k, w in enumerate(words) for n in (2, 5, 8)]  # similarity about 0.82 to 0.95
    rows += [(10 * k + 9, " ".join(edited(9 + k, w, 30))) for k, w in enumerate(words)]  # about 0.5: stays
    rows += [(500 + k, " ".join(edited(500 + k, words[0], 6))) for k in range(40)]  # a large group, not all near to each other
    rows += [(None, None), (None, " \t"), (700, "One  two"), (701, "one two"), (None, " ".join(words[1]))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    found = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found.collect()) == wanted(rows)


def test_large_buckets_give_the_same_groups(spark):
    w = [f"{x}{i % 97}" for i, x in enumerate(prose(3, 300).split())]
    rows = [(k, " ".join(edited(k, w, 2 + k % 12))) for k in range(60)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row long")
    found = jaccard.kept(docs, "row", tile=2000).collect()
    assert sorted((False, r["row"]) for r in found) == wanted(rows)


def test_sets_are_distinct_shingles():
    texts = ["", "a", "A  b\tc d", "a b c d e", "a b c d e a b c d e a b c d e", "x a b c d e"]
    hashes, first = jaccard.sets_of([t.encode() for t in texts], 5)
    found = [set(hashes[a:b].tolist()) for a, b in zip(first, first[1:])]
    assert [len(x) for x in found] == [len(sets(t)) for t in texts]
    assert all((found[i] & found[j] != set()) == (sets(texts[i]) & sets(texts[j]) != set()) for i in range(6) for j in range(i))


def test_groups_of_operator_5_have_an_effect(spark, sf_dir, monkeypatch):
    """A text 3 bits from another, of similarity 0.75, goes by operator 5 alone; one that chance puts into its group stays."""
    w = [f"{x}{i % 97}" for i, x in enumerate(prose(3, 400).split())]
    rows = [(1, " ".join(w)), (2, " ".join(edited(12, w, 12))), (3, " ".join(edited(5, w, 12))), (4, prose(9, 50)), (5, ""), (6, "one two three four five six")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    print_of = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, shingle=5).collect()}
    assert print_of == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6} and not near(sets(rows[0][1]), sets(rows[1][1]))
    ids = lambda: sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect())
    assert ids() == [1, 3, 4, 5, 6]
    alone = simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda docs, **k: alone(docs, **k).withColumn("component_id", F.col("doc_id")))
    assert ids() == [1, 2, 3, 4, 5, 6]
    monkeypatch.setattr(simhash, "near_duplicates", lambda docs, **k: alone(docs, **k).withColumn("component_id", F.lit(0)))
    assert ids() == [1, 4, 5, 6]


def test_all_pairs_of_a_group_are_compared(spark):
    """3 is near to 2 only, which is near to 1: by half, within the group given."""
    w = [f"w{i}" for i in range(404)]
    changed = lambda n: [f"x{x}" if k % 5 == 0 and k < 5 * n else x for k, x in enumerate(w)]
    rows = [(k, " ".join(changed(n)), k) for k, n in enumerate((0, 25, 50))]
    s = [sets(t) for _, t, _ in rows]
    assert [2 * len(s[a] & s[b]) >= len(s[a] | s[b]) for a, b in ((0, 1), (1, 2), (0, 2))] == [True, True, False]
    docs, groups = spark.createDataFrame(rows, "doc_id long, text string, row long"), spark.createDataFrame([(k, 7) for k in range(3)], "row long, group long")
    for tile in (100, 1 << 19):
        assert [r["row"] for r in jaccard.kept(docs, "row", groups, tile=tile).collect()] == [0]
    assert sorted(r["row"] for r in jaccard.kept(docs, "row").collect()) == [0, 1, 2]
