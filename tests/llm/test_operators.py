import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assay.llm import components, decontaminate, exact_dedup, language_id, lm_score, packing, quality, route, secret_scan, simhash, substring_dedup, text, url_filter
from tests.llm.cases import documents, frame, key, prose

SPACED = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def same(found, wanted):
    assert sorted(found, key=key) == sorted(wanted, key=key)


# --- text and routes


def test_words_and_hashes_follow_the_patterns():
    texts = [t or "" for _, t in documents()]
    data, at = text.joined([t.encode() for t in texts])
    starts, ends = text.spans(data, text.SPACED)
    raw = data.tobytes()
    words = [raw[a:b].decode() for a, b in zip(starts, ends)]
    assert words == [w for t in texts for w in SPACED.findall(t)]
    h = text.word_hashes(data, starts, ends)
    assert len({*zip(words, h.tolist())}) == len({*words}) == len({*h.tolist()})
    assert np.diff(np.searchsorted(starts, at)).tolist() == [len(SPACED.findall(t)) for t in texts]
    alnum = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    data, _ = text.joined([lower(t).encode() for t in texts])
    starts, ends = text.spans(data, text.ALNUM)
    assert [data.tobytes()[a:b].decode() for a, b in zip(starts, ends)] == [w for t in texts for w in alnum.findall(lower(t))]


def test_hashes_do_not_depend_on_segments(monkeypatch):
    data, _ = text.joined([prose(1, 500).encode(), b"y" * 3000, prose(2, 300).encode()])
    starts, ends = text.spans(data, text.SPACED)
    a, b = text.word_hashes(data, starts, ends), text.prefix_hashes(data, text.SPACED)
    monkeypatch.setattr(text, "_SEGMENT", 1000)
    assert np.array_equal(a, text.word_hashes(data, starts, ends)) and np.array_equal(b, text.prefix_hashes(data, text.SPACED))


def test_packed_lists_come_back():
    v = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64))
    assert np.array_equal(route.unpack_sorted(route.pack_sorted(v)), v)
    assert np.array_equal(route.unpack(route.pack(v.astype(np.int64)), np.int64), v.astype(np.int64))
    bits = v % 3 == 0
    assert np.array_equal(route.unpack_bits(route.pack_bits(bits), 1000), bits)
    known, of = text.distinct(np.concatenate([v, v[::-1]]), 6)
    assert np.array_equal(known[of], np.concatenate([v, v[::-1]])) and len(known) == 1000


# --- 1


URLS = ["https://www.Example.org/es/x?q#f", "http://a.example.org/en/14", "http://org/", "http://xorg/", "https://b.com/de/1", "https://b.com/fr/1", "https://b.com", "//no.scheme/x", None, "", "x://h?p#q", "http://spam.net/a.html", "https://m.spam.net/a/", "http://other.net/://x"]


def rule_of(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = lower(re.match("[^/?#]*", rest)[0])
    path = re.match("[^?#]*", rest[re.match("[^/?#]*", rest).end() :])[0]
    fits = [(len(k), k, v) for k, v in rules if (host == (h := k.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + k.split("/", 1)[1])]
    return host, path, max(fits) if fits else None


def test_url_rules(spark):
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(0, URLS[0], "h"), (None, URLS[4], None)], "page_id long, url string, host string")
    listed = spark.createDataFrame([*rules, ("=spam.net/a", "block"), ("com/de/", "block"), (None, "block")], "key string, verdict string")
    wanted = []
    for i, u in [*enumerate(URLS), (0, URLS[0]), (None, URLS[4])]:
        h, p, r = rule_of(u, rules)
        spam = re.sub(r"^(www|m)\.", "", h) + re.sub("/+$", "", re.sub(r"\.html$", "", p)) == "spam.net/a"
        wanted.append((i, h, p, r[1] if r else None, r[2] if r else "block" if spam else "allow", "spam.net/a" if spam else None))
    same([tuple(r) for r in url_filter.judge(pages, listed).collect()], wanted)
    same([tuple(r) for r in url_filter.judge(pages, listed, max_blocks=1).collect()], wanted)
    assert url_filter.judge(pages.limit(0), listed).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, listed.limit(0)).collect()} == {"allow"}


def test_a_full_filter_changes_nothing(spark):
    listed = spark.createDataFrame([(f"=h{i}.net/p", "block") for i in range(500)], "key string, verdict string")
    pages = spark.range(1000).selectExpr("id AS page_id", "concat('http://h', id, '.net/p') AS url")
    assert len(url_filter.filter_blocks(listed, 500, max_blocks=1)) == url_filter.WORDS
    for blocks in (1, 1 << 14):
        assert url_filter.judge(pages, listed, max_blocks=blocks).where("verdict = 'block'").count() == 500


def test_a_long_list_with_one_hot_url(spark):
    listed = spark.range(200_000).selectExpr("concat('=h', id, '.net/p') AS key", "'block' AS verdict")
    pages = spark.range(6000).selectExpr("id AS page_id", "if(id % 3 = 0, 'http://h7.net/p', concat('http://h', id, '.org/p')) AS url")
    got = url_filter.judge(pages, listed).groupBy("verdict").count().collect()
    assert {r["verdict"]: r["count"] for r in got} == {"block": 2000, "allow": 4000}


# --- 2


def test_base_spans(spark):
    rows = [(1, 'x password = "abcdefgh12" and TOKEN:short'), (2, "AKIA0123456789AB AKIA12 " + "0a" * 16 + " " + "f" * 31), (3, None), (4, ""), (None, "secret: api_key = abcdefgh"), (5, "ſecret=abcdefghij é token=abcdefgh.." * 3)]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "literal"] for r in secret_scan.scan(frame(spark, rows)).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in rows:
        t = t or ""
        wanted = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        wanted += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        wanted += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert got[i] == [(k, a, b) for a, _, k, b in sorted(wanted)], t
    assert got[None] == []


def test_lexing_follows_names_to_literals():
    found = lambda t: [(t[s["start"] : s["end"]], s["name"]) for s in secret_scan.secrets(t.encode()) if s["kind"] == "literal"]
    assert found('base = "k9Zp2qLmX7vT"\ndb_pwd = base\n') == [("k9Zp2qLmX7vT", "db_pwd")]
    assert found('{"privateKey": "Zx81kQpLm4Tz"}') == [("Zx81kQpLm4Tz", "privateKey")]
    assert found("<credential>Zx81kQpLm4Tz</credential>") == [("Zx81kQpLm4Tz", "credential")]
    assert found('authToken := "Zx81" + "kQpLm4Tz"') == [("Zx81", "authToken"), ("kQpLm4Tz", "authToken")]
    assert found('title = "k9Zp2qLmX7vT"\nkey: value\ndb_pwd = "${DB_PWD}"\npwd = changeme1234') == []
    assert found("the key = of all things: a private matter") == []


# --- 3


def hits_of(doc, items, width=13):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    w, hit, found = words(doc), set(), set()
    for name, t in items:
        b = words(t)
        n = min(width, len(b))
        for g in {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == g:
                    hit |= {*range(i, i + n)}
                    found.add(name)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 300}, {"block_bytes": 300, "group_blocks": 1}])
def test_decontamination(spark, sizes):
    items = [("10", prose(200, 40)), ("9", prose(105, 25)), ("8", "one"), ("7", None), ("6", ""), ("5", prose(1, 60)), ("4", prose(200, 40)), ("3", "stone river lamp")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = [*documents(), (70, prose(3, 300) + " " + prose(200, 14)), (71, (prose(200, 40) + " ") * 3)]
    wanted = [(i, *(h := hits_of(t, items)), h[1] > 0 and 20 * h[1] >= h[0]) for i, t in rows]
    got = decontaminate.overlaps(frame(spark, rows), bench, **sizes)
    same([(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got.collect()], wanted)
    assert decontaminate.overlaps(frame(spark, []), bench).count() == 0
    assert not decontaminate.overlaps(frame(spark), bench.limit(0)).where("n_hit > 0").count()


def test_matches_are_the_longest():
    a, b = prose(300, 50), prose(301, 20)
    block = decontaminate.Block(["i"], [a.encode()], 13)
    _, _, _, matches = decontaminate.find([(b + " " + a + " " + b).encode()], [block])
    assert matches[0] == [("i", 0, 20, 50)]


def test_longest_runs_equal_all_pairs():
    r = np.random.default_rng(8)
    for n in range(1, 40):
        a, b = (r.integers(0, 3, k).astype(np.uint64) for k in (n + 5, 12))
        runs = {(i, j, k) for k in range(2, 13) for j in range(len(a) - k + 1) for i in range(len(b) - k + 1) if np.array_equal(a[j : j + k], b[i : i + k])}
        wanted = min(((-k, j, i) for i, j, k in runs), default=None)
        got = decontaminate.longest(a, b, 2)
        assert (got is None) == (wanted is None) and (got is None or (-got[2], got[1], got[0]) == wanted)


def peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_repetitive_texts_take_bounded_memory():
    block = decontaminate.Block(["i"], [b"a " * 10_000], 13)
    found = []
    assert peak_mb(lambda: found.append(decontaminate.find([b"a " * 10**6], [block]))) < 1000
    assert found[0][1].all() and found[0][3] == [[("i", 0, 0, 10_000)]]


def test_suffix_array_orders_suffixes():
    r = np.random.default_rng(3)
    words, first = r.integers(0, 3, 200, dtype=np.uint64), np.array([0, 50, 50, 130, 200])
    s = decontaminate.SuffixArray(words, first, 13)
    suffix = lambda p: tuple(words[p : min(p + 13, first[np.searchsorted(first, p, "right")])].tolist())
    order = [suffix(p) for p in s.order]
    assert order == sorted(order)


# --- 4


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 2000, "slice_windows": 300, "cells_log2": 10}])
def test_substring_dedup(spark, sizes):
    rows = documents()
    words = [SPACED.findall(t or "") for _, t in rows]
    ids = [math.inf if i is None else i for i, _ in rows]
    least = {}
    for i, w in zip(ids, words):
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            least[g] = min(least.get(g, math.inf), i)
    wanted = []
    for (i, _), n, w in zip(rows, ids, words):
        gone = {j for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < n for j in range(k, k + 13)}
        wanted.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = substring_dedup.remove_repeated_passages(frame(spark, rows), **sizes)
    same([tuple(r) for r in got.collect()], wanted)
    assert substring_dedup.remove_repeated_passages(frame(spark, [])).count() == 0


# --- 5


def test_simhash(spark):
    rows = documents()

    def print_of(t):
        w = SPACED.findall(lower(t))
        shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))

    got = simhash.near_duplicates(frame(spark, rows), sample_size=8, shard_size=2)
    prints = [print_of(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                group = [group[b] if g == group[a] else g for g in group]
    least = {g: min((i for (i, _), x in zip(rows, group) if x == g and i is not None), default=None) for g in group}
    same([(r["doc_id"], r["hex"], r["component_id"]) for r in got.withColumn("hex", simhash.as_hex(F.col("fingerprint"))).collect()], [(i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, group)])
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("options", [{"shard_size": 16, "sample_size": 256}, {"shard_size": 64, "tile": 20, "sample_size": 64}, {"segments": 2, "shard_size": 16}])
def test_links_find_every_close_pair(spark, options):
    r = np.random.default_rng(4)
    seeds = r.integers(0, 2**63, 60, dtype=np.uint64)
    near = [int(s) ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 7), replace=False)) for s in np.repeat(seeds, 8)]
    values = sorted({x - (1 << 64) if x >> 63 else x for x in near})
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fingerprint long"), **options)
    got = {x["node"]: x["component"] for x in components.components(edges).collect()}
    u = np.array(values).view(np.uint64)
    pairs = [(values[a], values[b]) for a, b in zip(*np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u) <= 4, 1)))]
    assert pairs and all(got[a] == got[b] for a, b in pairs)
    group = {v: {v} for v in values}
    for a, b in pairs:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    assert len({got.get(v, v) for v in values}) == len({id(g) for g in group.values()})


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (1, 0), (1, 0)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(101)}) == 1 and len({got[1000 + i] for i in range(200)}) == 1 and got[0] != got[1000] and 5000 not in got


# --- 6


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    odd = "It's <|endoftext|> DON'T 12a3 ß İ ﬁ 東京\u3000x \u00a0y e\u0301 a<|b ...'s"
    rows = [*documents(), (80, odd), (81, prose(4, 9000))]
    got = packing.pack(frame(spark, rows), path).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    total = Counter()
    for i, t in rows:
        total[i] += len(plain.encode(t or "", add_special_tokens=False).ids) + 1
    for i, t in rows:
        if i in (None, 41):
            assert sum(r["length"] for r in by[i]) == total[i]
            continue
        ids, at = plain.encode(t or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and np.array_equal(np.frombuffer(r["ids"], "<u4"), ids[at : at + r["length"]]), t
            at += r["length"]
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack(frame(spark, []), path).count() == 0


def test_pieces_nearly_fill_their_share():
    lengths = np.arange(1, 9000)
    doc, start, length, c = packing.cut(lengths, 2048, 40)
    assert np.array_equal(np.bincount(doc, length)[: len(lengths)], lengths)
    k = packing.classes(2048)[c]
    assert (k * length <= 2048).all()
    assert ((2048 - k * length)[k < 32] <= 40).all()


# --- 7


def test_exact_dedup(spark):
    rows = documents()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    got = exact_dedup.mark_duplicates(frame(spark, rows), max_words=2).collect()
    assert len(got) == len(rows)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    by = defaultdict(list)
    for r in got:
        by[r["text_sha256"]].append(r)
    for t, ids in groups.items():
        found = by[hashlib.sha256(t.encode()).hexdigest()]
        last = max((i for i in ids if i is not None), default=None)
        assert sorted(r["doc_id"] for r in found if r["doc_id"] is not None) == sorted(i for i in ids if i is not None)
        assert {(r["keep_id"], r["group_size"]) for r in found} == {(last, len(ids))}
        assert kept[found[0]["text_sha256"]] == 1 and all(r["doc_id"] == last for r in found if r["kept"])
    assert exact_dedup.mark_duplicates(frame(spark, [])).count() == 0


def test_filter_has_a_bound():
    assert exact_dedup.filter_words(10) == 4 and exact_dedup.filter_words(10**12) == 1 << 20


# --- 8


def test_lm_score(spark):
    rows = documents()
    got = lm_score.score(frame(spark, rows), chunk_bytes=20000, slice_bytes=50000)
    counts = Counter()
    tokens = lambda t: [*SPACED.findall(lower(t)), None]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    for i, t in rows:
        if not out(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    wanted = [(i, out(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows]
    found = got.collect()
    same([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found], wanted)
    assert all(r["score"] < 0 for r in found)
    assert lm_score.score(frame(spark, [])).count() == 0


def lm_tokens(t, planes):
    """(bytes, class) of each token: a run without white space and the byte that ends it."""
    raw, out, begin = lower(t).encode() + b"\n", [], 0
    for k, b in enumerate(raw):
        if b in b" \t\n\v\f\r":
            sides = [sum(int(w[s]) for s in lm_score.pair_slots(np.frombuffer(raw[:begin], np.uint8))) for w in planes.weights]
            kind = lm_score.NO_CLASS if not begin else sum((v > 0) << i for i, v in enumerate(sides))
            out.append((raw[begin:k] + (b"\0" if k == len(raw) - 1 else raw[k : k + 1]), kind))
            begin = k + 1
    return out


def lm_contexts(token, kind):
    for k in range(len(token)):
        before = token[:k]
        padded = before[::-1] + b"\0" * 5
        yield token[k], [((p, padded[:n] if n else before), kind if c else None) for p, (n, c) in enumerate(lm_score.SEEN)]


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 700, "slice_bytes": 900, "rounds": 1}])
def test_lm_score_equals_a_plain_model(spark, sizes):
    rows = [(i, t) for i, t in documents() if len(t or "") < 900] + [(90, "a\0b  c\n\nThe THE the"), (91, prose(2, 60).replace(" ", "\t"))]
    c = lm_score.read(frame(spark, rows), **sizes)
    seen = defaultdict(Counter)
    for i, t in rows:
        if not lm_score.held_out(i, 7, 2):
            for token, kind in lm_tokens(t, c.planes):
                for b, found in lm_contexts(token, kind):
                    for x in found:
                        seen[x][b] += 1

    def log10(t):
        total = 0.0
        for token, kind in lm_tokens(t, c.planes):
            for b, found in lm_contexts(token, kind):
                for bit in range(8):
                    n = [[sum(m for y, m in seen[x].items() if y >> (8 - bit) == b >> (8 - bit) and y >> (7 - bit) & 1 == one) for one in (0, 1)] for x in found]
                    odds = [math.log((ones + 0.05) / (zeros + 0.05)) for zeros, ones in n]
                    level = [sum(sum(n[p]) >= v for v in (1, 2, 4, 12, 100)) for p in (4, 3, 2)]
                    gate = ((bit * 6 + level[0]) * 6 + level[1]) * 6 + level[2]
                    stretch = max(-12.0, min(12.0, sum(o * w for o, w in zip(odds, c.mixer.weights[gate]))))
                    x = (stretch + 12) * 32 / 24
                    lo, earlier = min(int(x), 31), (b | 256) >> (8 - bit)
                    table = c.mixer.refine[lo, earlier] * (1 - x + lo) + c.mixer.refine[lo + 1, earlier] * (x - lo)
                    one = min(max((1 / (1 + math.exp(-stretch)) + table) / 2, 1e-6), 1 - 1e-6)
                    total += math.log10(one if b >> (7 - bit) & 1 else 1 - one)
        return total

    wanted = sorted(((i, round(log10(t), 2)) for i, t in rows), key=key)
    got = sorted(((r["doc_id"], round(r["score"], 2)) for r in lm_score.score(frame(spark, rows), **sizes).collect()), key=key)
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 0.02 for a, b in zip(got, wanted)) and len(got) == len(wanted)


def test_lm_is_better_than_words_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("n"))
    r = lm_score.score(docs).where("held_out").join(size, "doc_id").agg(*[(-F.sum(c) * math.log2(10) / F.sum("n")).alias(c) for c in ("score", "base_score")]).first()
    assert r["score"] < 0.99 * r["base_score"], r


# --- 9


def test_language_id(spark):
    import random

    r = random.Random(1)
    tongues = {"aa": ["tha", "ing", "wer", "ond"], "bb": ["zué", "qña", "llo", "rra"], "cc": ["сло", "вод", "мир", "под"]}
    made = lambda g, n: " ".join("".join(r.choice(tongues[g]) for _ in range(3)) for _ in range(n))
    rows = [(i, made(g, 30), g) for i, g in enumerate("aa bb cc".split() * 20)] + [(200, None, "aa"), (201, "12 !!", "bb"), (202, "", None), (None, made("aa", 10), None), (203, made("cc", 3) * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert all(got[i]["lang_pred"] == g for i, _, g in rows[:60]) and got[203]["lang_pred"] == "cc" and got[None]["lang_pred"] == "aa"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (200, 201, 202))
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(60)) and all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs.where("lang is null")).collect()} == {"und"}


def test_language_vectors_equal_a_plain_sum(spark):
    size, texts = 64, ["Ab c", "", "12", "zué qña ab", "ab ab abab"]
    vector = lambda t: np.roll(language_id.letter_vector(t[0], size), 2) * np.roll(language_id.letter_vector(t[1], size), 1) * language_id.letter_vector(t[2], size)
    wanted = np.zeros((len(texts), size))
    for d, t in enumerate(texts):
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            c = [0, *map(ord, w), 0]
            wanted[d] += sum(vector(c[i : i + 3]).astype(int) for i in range(len(w)))
    known, of, doc = language_id.trigrams(texts)
    for block, owners in ((2048, 256), (3, 2)):
        assert np.array_equal(language_id.bundles(known, of, doc, np.ones(len(of)), len(texts), size, block, owners), wanted)
    profiles = language_id.Profiles(["x", "y"], np.eye(2, size))
    best, score = profiles.predict(texts)
    cosine = wanted[:, :2] / np.maximum(np.linalg.norm(wanted, axis=1, keepdims=True), 1e-30)
    assert best.tolist() == [-1 if not w.any() else int(c.argmax()) for w, c in zip(wanted, cosine)]
    assert np.allclose(score, [0 if not w.any() else max(0, c.max()) for w, c in zip(wanted, cosine)])


def test_texts_of_many_letters_take_bounded_memory():
    r = np.random.default_rng(5)
    t = "".join(map(chr, r.integers(0x4E00, 0x4E00 + 20_000, 200_000)))
    profiles = language_id.Profiles(["x"], np.eye(1, 1024))
    assert peak_mb(lambda: profiles.predict([t])) < 1000


def test_profiles_ignore_partitions_and_held_out_labels(spark):
    docs = spark.createDataFrame([(i, prose(i, 40), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, lang string")
    rounded = lambda df: df.withColumn("score", F.round("score", 4)).orderBy("doc_id").collect()
    a = rounded(language_id.identify(docs.repartition(5)))
    lied = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id"), 3, 1), "zz").otherwise(F.col("lang")))
    assert a == rounded(language_id.identify(lied.coalesce(1)))


# --- 10


def test_quality(spark):
    good = [(i, prose(i, 60)) for i in range(80)]
    bad = [(100 + i, " ".join(w + "$$$" for w in prose(i, 60).split())) for i in range(40)]
    rows = [*good, *bad, (300, None), (301, ""), (None, prose(1, 20)), (302, prose(2, 30000)), (303, "$$$ " * 40)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(1, 1, 0), (None, 0, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert all(got[i]["predicted"] == 1 for i, _ in good) and all(got[i]["predicted"] == 0 for i, _ in bad) and got[302]["predicted"] == 1 and got[303]["predicted"] == 0
    lied = labels.withColumn("quality", F.when(language_id.held_out(F.col("doc_id"), 4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {i: r["score"] for i, r in got.items()} == {r["doc_id"]: r["score"] for r in quality.score(docs, lied).collect()}
    assert quality.score(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}


def test_votes_equal_all_neighbours_in_order(spark):
    texts = [prose(k, 30 + k) if k % 3 else " ".join(w + "$%" for w in prose(k, 25).split()) for k in range(90)]
    docs, labels = frame(spark, list(enumerate(texts))), spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(90)], "doc_id long, quality int, toxic int")
    voters = quality.fit_apart(docs, labels)
    mine = [prose(500, 40), "$$ %% $$", "", *texts[:5]]
    got = voters.score([t.encode() for t in mine], block=3)
    for t, s in zip(mine, got):
        v = quality.unit((quality.terms([t.encode()]) * voters.weights) @ voters.axes)[0]
        near = sorted(((float(v @ x), y) for x, y in zip(voters.vectors, voters.labels)), reverse=True)[: voters.neighbours]
        weight = [max(0.0, min(1.0, c)) ** voters.power for c, _ in near]
        assert abs(s - (sum(w * y for w, (_, y) in zip(weight, near)) / sum(weight) if sum(weight) else voters.prior)) < 1e-4


def test_held_out_quality_and_language(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, labels).where("held_out").join(labels.select("doc_id", "quality").where("quality is not null"), "doc_id").select("score", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == k] for k in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    told = language_id.identify(docs).where("held_out").join(docs.where("lang is not null").select("doc_id", "lang"), "doc_id").where("lang_pred <> 'und'")
    assert told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.99
