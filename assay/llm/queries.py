"""The operators as queries over the given tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import conversation_trie, decontaminate, exact_dedup, filter_audit, language_id, lm_score, mixing, packing, quality, secret_scan, simhash, substring_dedup, url_filter

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: The given tables have no block list: the canonical URLs of pages on these hosts, and of pages with
#: such marks in their titles, are the query's. Other pages are blocked if their URL is one of them.
BAD_TITLE = r"<title>[^<]*(%%%|[*]{3}|###)"
BLOCKED_HOSTS = r"(^|\.)(casino-win|free-bets|spam-farm)\.example\.(com|net|org)$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host, path = url_filter.host(F.col("url")), url_filter.path(F.col("url"))
    seen = pages.where(host.rlike(BLOCKED_HOSTS) | ((host != "") & F.col("html").rlike(BAD_TITLE))).select(url_filter.canonical(host, path).alias("key"), F.lit("block").alias("verdict"))
    listed = spark.createDataFrame(list(RULES), "key string, verdict string").unionByName(seen)
    return url_filter.judge(pages, listed)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS]
    return found.select("doc_id", *counts, F.sha2(secret_scan.digest(of(*secret_scan.KINDS[:3])), 256).alias("base_sha256"), secret_scan.digest(F.col("spans")).alias("spans"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0).cast("long"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", longest.alias("longest_match"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.numbered(table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(*conversation_trie.rebranched(turns))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_secret_scan, op3_decontaminate, op4_substring_dedup, op5_simhash, op6_packing, op7_exact_dedup, op8_lm_score, op9_language_id, op10_quality, op11_conversation_trie, op12_source_mix, op13_filter_audit)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_url_filter": f"""
WITH parts AS (
  SELECT page_id, url, html,
    CASE WHEN contains(url, '://') THEN {_LOWER.format("regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*')")} ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
keyed AS (SELECT *, regexp_replace(host, '^(?:www|m)\\.', '') || regexp_replace(regexp_replace(path, '\\.html$', ''), '/+$', '') AS canon FROM parts),
listed AS (SELECT DISTINCT canon FROM keyed WHERE regexp_matches(host, '(^|\\.)(casino-win|free-bets|spam-farm)\\.example\\.(com|net|org)$') OR (host <> '' AND regexp_matches(html, '<title>[^<]*(%%%|[*]{{3}}|###)'))),
rules(h, p, v) AS (VALUES {", ".join(f"('{k.partition('/')[0]}', '/{k.partition('/')[2]}', '{v}')" for k, v in RULES)}),
best AS (
  SELECT k.page_id, max(struct_pack(n := length(h || p), r := h || p, v := v)) AS b
  FROM keyed k JOIN rules ON (k.host = h OR ends_with(k.host, '.' || h)) AND starts_with(k.path, p) GROUP BY k.page_id)
SELECT k.page_id, k.host, k.path, b.r AS rule, coalesce(b.v, CASE WHEN l.canon IS NOT NULL THEN 'block' END, 'allow') AS verdict, l.canon AS listed
FROM keyed k LEFT JOIN best USING (page_id) LEFT JOIN listed l ON l.canon = k.canon AND k.host <> ''
""",
    "op3_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS g, least(13, len(w)) AS n
  FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d JOIN sizes ON len(w) >= n)),
hits AS (SELECT doc_id, s, bw.n, item_id FROM dw JOIN bw ON bw.g = dw.g AND bw.n = dw.n),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS l FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id),
runs AS (SELECT doc_id, max(len) AS longest FROM (
  SELECT doc_id, item_id, max(s) - min(s) + max(n) AS len FROM (
    SELECT *, s - row_number() OVER (PARTITION BY doc_id, item_id, s - p ORDER BY s) AS grp FROM (
      SELECT dw.doc_id, dw.s, bp.n, bp.item_id, bp.p FROM dw JOIN (
        SELECT item_id, s AS p, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)) bp ON bp.g = dw.g AND bp.n = dw.n))
  GROUP BY doc_id, item_id, s - p, grp, grp) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN runs USING (doc_id)
""",
    "op4_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s : s + 12], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 11)) AS s FROM d)),
least_doc AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM win JOIN least_doc USING (g) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT word.doc_id, count(gone.i) AS n_removed, string_agg(x, ' ' ORDER BY word.i) FILTER (WHERE gone.i IS NULL) AS t FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
""",
    "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
    "op11_conversation_trie": """
WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
  lambda s, x: list_reduce(list_prepend(xor(s, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) AS crc FROM (SELECT DISTINCT conv_id FROM t)),
h AS (SELECT conv_id, xor(crc, 4294967295) % 9 AS h FROM c),
rows AS (
  SELECT conv_id, 1 AS part, r, role, text FROM t JOIN h USING (conv_id) WHERE conv_id % 5 = 0 OR r > h
  UNION ALL SELECT h.conv_id, 0, r, role, text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 5 WHERE h.conv_id % 5 <> 0 AND r <= h),
conv AS (SELECT h.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY part, r) FILTER (WHERE r IS NOT NULL), []) AS l FROM h LEFT JOIN rows USING (conv_id) GROUP BY h.conv_id),
p AS (SELECT conv_id, unnest(range(0, len(l) + 1)) AS d, l FROM conv),
member AS (SELECT conv_id, d, l[1 : d] AS k, d = len(l) AS last, CASE WHEN d = 0 THEN 0 ELSE strlen(l[d].text) END AS bytes FROM p),
node AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * max(bytes) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM member GROUP BY d, k),
tree AS (SELECT v.*, u.conv_id AS parent FROM node v LEFT JOIN node u ON u.d = v.d - 1 AND u.k = v.k[1 : v.d - 1]),
kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n_children FROM tree WHERE d > 0 GROUP BY parent, d),
under AS (SELECT conv_id AS top, d AS top_d, conv_id, d, saved FROM tree UNION ALL SELECT top, top_d, tree.conv_id, tree.d, tree.saved FROM under JOIN tree ON tree.parent = under.conv_id AND tree.d = under.d + 1),
sums AS (SELECT top AS conv_id, top_d AS d, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM under LEFT JOIN kids USING (conv_id, d) GROUP BY top, top_d)
SELECT tree.conv_id, tree.d AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
FROM tree LEFT JOIN kids USING (conv_id, d) JOIN sums USING (conv_id, d)
""",
    "op12_source_mix": f"""
WITH RECURSIVE docs AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
src AS (SELECT source, source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source)),
fill(k, lvl, n) AS (
  SELECT 0, 1.5::DOUBLE * sum(source_size)::DOUBLE / sum(w)::DOUBLE, 0 FROM src
  UNION ALL SELECT k + 1, CASE WHEN o > 0 THEN (1.5::DOUBLE * a::DOUBLE - 2::DOUBLE * s::DOUBLE) / o::DOUBLE ELSE 'inf'::DOUBLE END, m FROM (
    SELECT k, n, count(*) FILTER (WHERE 2 * source_size < lvl * w) AS m, sum(source_size) AS a, coalesce(sum(source_size) FILTER (WHERE 2 * source_size < lvl * w), 0) AS s,
      coalesce(sum(w) FILTER (WHERE NOT 2 * source_size < lvl * w), 0) AS o FROM fill, src GROUP BY k, n) WHERE m <> n),
goal AS (SELECT source, source_size, least(2::DOUBLE * source_size, (SELECT max_by(lvl, k) FROM fill) * w) AS target FROM src),
rate AS (SELECT *, floor(r) AS whole, r - floor(r) AS fraction FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS r FROM goal)),
draw AS (SELECT d.*, source_size, target, whole, s, CAST('0x' || substr(md5(concat_ws('|', CAST(s // 4 AS VARCHAR), CAST(doc_id AS VARCHAR), CAST(size AS VARCHAR))), 8 * (s % 4) + 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < fraction AS more
  FROM (SELECT *, unnest(range({mixing.SEEDS})) AS s FROM docs) d JOIN rate ON rate.source IS NOT DISTINCT FROM d.source),
tried AS (SELECT source, s, abs(any_value(target) - (any_value(whole) * any_value(source_size) + coalesce(sum(size) FILTER (WHERE more), 0))) AS gap FROM draw GROUP BY source, s),
best AS (SELECT source, arg_min(s, (gap, s)) AS s FROM tried GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM draw JOIN best ON best.source IS NOT DISTINCT FROM draw.source AND best.s = draw.s
""",
    "op13_filter_audit": """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS f FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
cell AS (SELECT part, f, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, f),
k AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, step, o[step] AS own, o[1 : step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
x AS (SELECT *, f[own] AS fails, len(list_filter(before, lambda b: f[b])) > 0 AS gone, len(list_filter(f, lambda b: b)) AS m FROM s, cell)
SELECT part, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, CAST(step AS INT) AS step,
  CAST(coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (WHERE fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE fails AND m = 1), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // greatest(m, 1)) FILTER (WHERE fails), 0) AS BIGINT) AS shapley
FROM x GROUP BY part, o, step, own
""",
}
