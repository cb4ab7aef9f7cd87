import random

import pytest

from assay.llm import jaccard
from assay.llm.components import components
from tests.llm.cases import prose
from tests.llm.test_near import edited, wanted


def reached(edges):
    """The nodes of each component, by label propagation."""
    group = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    return {frozenset(x for x in group if group[x] == g) for g in group.values()}


def found(labels):
    groups = {}
    for node, component in labels:
        groups.setdefault(component, set()).add(node)
    assert all(component in own for component, own in groups.items())
    return {frozenset(x) for x in groups.values()}


@pytest.fixture
def many_parts(spark):
    """As on a large cluster: many shuffle partitions, and Spark does not merge them."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def tasks_of(spark, run):
    """What run() gives, and how many tasks it took."""
    context = spark.sparkContext._jsc.sc()

    def ended():
        context.listenerBus().waitUntilEmpty(30_000)
        listed = context.statusStore().executorList(False)
        return sum(listed.apply(k).completedTasks() for k in range(listed.size()))

    before = ended()
    out = run()
    return out, ended() - before


def test_rounds_over_few_edges_take_few_tasks(many_parts):
    """A task for each of 64 shuffle partitions, in each of some 30 stages, would be 2,000."""
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(1000, 1000 + k) for k in range(1, 60)] + [(r.randrange(2000, 2200), r.randrange(2000, 2200)) for _ in range(120)] + [(7, 7)]
    df = many_parts.createDataFrame(edges, "a long, b long")
    labels, tasks = tasks_of(many_parts, lambda: [(x["node"], x["component"]) for x in components(df).collect()])
    assert found(labels) == reached(edges) and len(dict(labels)) == len(labels)
    assert tasks < 500


def test_edges_in_many_parts_give_the_same_components(many_parts, monkeypatch):
    """Two rows a part: small tables are shuffled again."""
    monkeypatch.setattr("assay.llm.shared.PART", 2)
    edges = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 20)]
    df = many_parts.createDataFrame(edges, "a long, b long")
    for most in (1 << 20, 10, 0):
        assert found((x["node"], x["component"]) for x in components(df, most=most).collect()) == reached(edges)


def test_near_copies_take_few_tasks(many_parts):
    w = [f"{x}{i % 97}" for i, x in enumerate(prose(3, 300).split())]
    rows = [(k, " ".join(edited(k, w, 2 + k % 12))) for k in range(30)]
    docs = many_parts.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row long")
    groups = many_parts.createDataFrame([(k, k % 2) for k in range(30)], "row long, group long")
    kept, tasks = tasks_of(many_parts, lambda: [x["row"] for x in jaccard.kept(docs, "row", groups, group_tenths=8).collect()])
    assert sorted((False, k) for k in kept) == wanted(rows)
    assert tasks < 5500
