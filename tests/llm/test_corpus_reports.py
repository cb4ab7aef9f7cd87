"""Conversation trie, source mixing and filter audit against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assay.llm import conversation_trie, filter_audit, mixing
from tests.llm.cases import documents, prose

SPACED = re.compile("[^\x20\x09-\x0d]+")

# --- conversation trie


def conversations(seed: int, n: int = 60) -> list[tuple]:
    """Rows (conv_id, turn, role, text) that share beginnings; nulls, equal turns that are alike, a long conversation."""
    r = random.Random(seed)
    rows = []
    for c in [*range(n), -3, -5, -10, 2**62, -(2**63), 2**63 - 1]:
        for t in range(r.choice([1, 2, 3, 3, 4, 9])):
            rows.append((c, t, r.choice(["user", "assistant", None]) if t else "user", r.choice(["", None, "a", "é", "longer text"]) if t else r.choice(["hello", "hi"])))
    rows += [(200, t, "user", f"t{t // 2}") for t in range(300)] + [(201, t, "user", f"t{t // 2}") for t in range(290)]
    rows += [(7, None, "system", "first of all"), (300, 1, "u", "same"), (300, 1, "u", "same"), (None, 0, "user", "lost"), (404, 0, "user", "no base")]
    r.shuffle(rows)
    return rows


def plain_trie(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        base, h = c - int(np.fmod(c, 5)) if abs(c) < 2**53 else c - (abs(c) % 5) * (1 if c > 0 else -1), zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = turns if base == c else own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in sorted(rebuilt.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, cs in members.items():
        under = [m for m in members if m[: len(node)] == node]
        children = {m for m in under if len(m) == len(node) + 1}
        leaves = sum(not any(k[:-1] == m for k in members if k) for m in under)
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in under if m)
        ends = ",".join(str(c) for c in cs if len(rebuilt[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("seed,bounds", [(1, {}), (2, {"least": 1, "most": 4}), (3, {"least": 2, "most": 1 << 17, "limit": 3})])
def test_trie_equals_brute_force(spark, seed, bounds):
    rows = conversations(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit(1), "p1": F.lit("x"), "part": F.lit(2), "shard": F.lit(None)}).repartition(4)
    found = conversation_trie.prefix_trie(*conversation_trie.rebranched(conversation_trie.numbered(df)), **bounds)
    assert order(found.collect()) == order(plain_trie(rows))


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.prefix_trie(*conversation_trie.rebranched(conversation_trie.numbered(empty))).count() == 0
    c = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    one = spark.createDataFrame([(c, 0, "u", "gone")], empty.schema)
    assert [tuple(r) for r in conversation_trie.prefix_trie(*conversation_trie.rebranched(conversation_trie.numbered(one))).collect()] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_queue_gives_rows_by_parent_from_memory_and_disk():
    r = np.random.default_rng(1)
    keys = conversation_trie._keys(r.integers(-(2**63), 2**63, 500), r.integers(-5, 5, 500))
    queue = conversation_trie.Waiting(limit=64)
    for part in np.array_split(np.arange(500), 37):
        rows = np.zeros(len(part), conversation_trie._ROW)
        rows["key"], rows["conv_id"] = keys[part], part
        queue.add(rows)
    assert len(queue.runs) >= 5
    queue.full()
    wanted, seen = np.argsort(keys, kind="stable"), []
    for upto in np.sort(keys)[49::50]:
        seen.append(np.sort(queue.pop(upto)["conv_id"]))
    assert queue.empty and np.concatenate(seen).tolist() == np.concatenate([np.sort(x) for x in np.split(wanted, 10)]).tolist()


def test_a_lost_parent_is_an_error():
    schema = pa.schema([*[(c, pa.int64()) for c in ("depth", "p1", "p2", "q1", "q2", "conv_id", "n_convs", "bytes", "n_children", "n_leaves", "saved_tokens")], ("edge", pa.bool_()), ("ends", pa.binary())])
    row = {n: 1 for n in schema.names[:-2]} | {"edge": False, "ends": b"x" * 32, "depth": 2}
    with pytest.raises(RuntimeError):
        list(conversation_trie.time_forward(iter([pa.RecordBatch.from_pylist([row], schema)])))


# --- mixing


def plain_targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        above = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not above:
            return target | {s: level * w[s] for s in open_}
        target |= {s: most * sizes[s] for s in above}
        left -= sum(most * sizes[s] for s in above)
        open_ -= above
    return target


def sourced(seed: int, n: int = 900) -> list[tuple]:
    r = random.Random(seed)
    names = ["web", "web", "web", "books", "code", None, "émission", "z", ""]
    rows = [(i, prose(i, r.choice([0, 1, 5, 30, 60])), names[i % 9 if i % 3 else 0]) for i in range(n)]
    return [*rows, (None, "a b c", "web"), (None, None, "web"), (5, None, None), (6, "x", "tiny"), *[(7, "twice the same row", "code")] * 2, (n, prose(3, 9000), "books")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_its_targets(spark, seed):
    rows = sourced(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("s"), "copies": F.lit(9), "target": F.lit(0)}).repartition(5)
    found = mixing.copies(df).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(SPACED.findall(t or ""))
    wanted, taken = plain_targets(sizes), defaultdict(int)
    assert len(found) == len(rows) and sorted(r["size"] for r in found) == sorted(len(SPACED.findall(t or "")) for _, t, _ in rows)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]])
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["copies"] in (int(rate), min(2, int(rate) + 1))
        taken[r["source"]] += r["size"] * r["copies"]
    assert sum(wanted.values()) == pytest.approx(1.5 * sum(sizes.values()))
    longest = {s: max(r["size"] for r in found if r["source"] == s) for s in sizes}
    assert all(abs(taken[s] - wanted[s]) <= 0.01 * wanted[s] + longest[s] / 2 for s in sizes)
    shuffled = mixing.copies(df.repartition(2), broadcast=0).collect()
    assert sorted(map(repr, shuffled)) == sorted(map(repr, found))
    for broadcast in (0, 99):
        mixed = mixing.mix(df, broadcast=broadcast)
        assert mixed.columns == df.columns
        counts = {(r["doc_id"], r["text"]): r["count"] for r in mixed.groupBy("doc_id", "text").count().collect()}
        assert sum(counts.values()) == sum(r["copies"] for r in found)


def test_mix_of_nothing_and_of_other_weights(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.copies(df).count() == 0 and mixing.mix(df).count() == 0
    rows = [(i, prose(i, 20), "ab"[i % 2]) for i in range(400)]
    found = mixing.copies(spark.createDataFrame(rows, df.schema), weights=(1, 3), share=0.5, most=1.0).collect()
    words = {s: sum(r["size"] * r["copies"] for r in found if r["source"] == s) for s in "ab"}
    assert words["b"] == pytest.approx(3 * words["a"], rel=0.02) and sum(words.values()) == pytest.approx(4000, rel=0.02)
    none = mixing.copies(spark.createDataFrame([(1, "", "a"), (2, None, "b")], df.schema)).collect()
    assert [(r["copies"], r["target"]) for r in none] == [(0, 0.0)] * 2


# --- filter audit


def audited_documents() -> list[tuple]:
    rows = [(i, t, ["s", "", None, "other"][k % 4]) for k, (i, t) in enumerate(documents())]
    rows += [(100 + i, prose(i, 250), "s") for i in range(20)] + [(200 + i, prose(i % 4, 250), "other") for i in range(12)]
    rows += [(300, " ".join(f"w{i}" for i in range(300)), "s"), (301, " ".join(f"w{i}" for i in range(300)) + " #", None), (302, "ABC " * 300, "s"), (303, " ".join(f"Word{i}" for i in range(250)), "s")]
    return rows


def plain_audit(rows: list[tuple], labels: list[tuple]) -> list[tuple]:
    good, toxic, least = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}, {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = SPACED.findall(t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t]]
        docs.append((s or "", {f for f, x in zip("ABCDE", fails) if x}, i in good, i in toxic))
    out, shapley = [], defaultdict(int)
    for part in {d[0] for d in docs}:
        for order_ in permutations("ABCDE"):
            for k, f in enumerate(order_):
                shapley[part, f] += sum(f in fails and not fails & set(order_[:k]) for p, fails, _, _ in docs if p == part)
        for order_ in permutations("ABCDE"):
            for k, f in enumerate(order_):
                mine = [d for d in docs if d[0] == part]
                gone = [d for d in mine if d[1] & set(order_[:k])]
                removed = [d for d in mine if f in d[1] and d not in gone]
                out.append((part, "".join(order_), k + 1, len(mine) - len(gone) - len(removed), len(removed), sum(f in d[1] for d in gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in removed), sum(d[3] for d in removed), shapley[part, f]))
    return out


def test_audit_equals_brute_force(spark):
    rows, labels = audited_documents(), [(1, 1, 0), (1, 0, 1), (41, 1, 0), (105, 1, 1), (205, 0, 1), (None, 1, 1), (301, None, None), (999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"mask": F.lit(1), "part": F.lit("p"), "prefix": F.lit(None)}).repartition(4)
    found = filter_audit.audit(filter_audit.masks(docs, 2000), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in found.collect()) == sorted(plain_audit(rows, labels))
    assert filter_audit.audit(filter_audit.masks(docs.limit(0)), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_trie_holds_each_text_once():
    r = random.Random(5)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(0, 9))) for _ in range(400)] + [b"", b"ab" * 5000, b"ab" * 5000 + b"c"]
    trie = filter_audit.Radix()
    for row, t in enumerate(texts):
        trie.insert(t, -row, row)
    found = {tuple(sorted(n.rows)): n.least for n in trie.terminals()}
    wanted = defaultdict(list)
    for row, t in enumerate(texts):
        wanted[t].append(row)
    assert found == {tuple(v): -max(v) for v in wanted.values()}
    left = [trie]
    while left:  # compressed: only a terminal or the root has fewer than two children
        node = left.pop()
        assert node is trie or node.rows is not None or len(node.next) >= 2
        left.extend(node.next.values())


def test_prefixes_grow_until_ranges_are_small(spark):
    rows = [(i, "the same beginning " * 20 + prose(i, 3)) for i in range(200)] + [(i, "alike") for i in range(500, 900)] + [(1000, "x" * 90000)]
    heavy, most, total = filter_audit.heavy_prefixes(spark.createDataFrame(rows, "doc_id long, text string"), 8000)
    assert most == 8000 and total == sum(len(t.encode()) for _, t in rows) and len(heavy) > 5 and not heavy[max(heavy)]
    sets = {n: {h & (2**64 - 1) for h in hs} for n, hs in heavy.items()}
    weight = defaultdict(lambda: defaultdict(int))
    for _, t in rows:
        weight[filter_audit._prefix(t.encode(), sets)][t] += len(t.encode())
    assert all(len(own) == 1 or sum(own.values()) <= 1000 for own in weight.values())
