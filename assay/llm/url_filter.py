"""URL filters by a blocked Bloom filter, in DataFrame functions only.

Listed entries are hosts with a path prefix (rules) or whole canonical URLs. Each URL yields its
possible keys: every suffix of its host with every prefix of its path of a length that the list
has, and its canonical form. A row without a key that the filter holds passes straight, unshuffled.
The others' keys go on to an exact hash join with the list, which removes false positives; the keys
met are joined with the list first, each once, and then dealt with the rows over salts, so that a
key that many rows share is not one task's work.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WWW = r"^(?:www|m)\."


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading `www.` or `m.`, path without `.html` and closing slashes; scheme, query and fragment don't count."""
    return F.concat(F.lit("="), F.regexp_replace(host, WWW, ""), F.regexp_replace(F.regexp_replace(path, r"\.html$", ""), "/+$", ""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column, word: int) -> Column:
    """Two bits in each of a block's four words, from hashes that don't choose the block."""
    h = F.xxhash64(key, F.lit(word + 1))
    one = F.lit(1).cast("long")
    bit = lambda n: F.call_function("shiftleft", one, F.call_function("shiftrightunsigned", h, F.lit(n)).bitwiseAND(F.lit(63)).cast("int"))
    return bit(58).bitwiseOR(bit(20))


WORDS = 4
#: Parts into which the rows of each key are dealt.
SALTS = 32


def filter_blocks(entries: DataFrame, keys: int, bits_per_key: int = 16, max_blocks: int = 1 << 14) -> list[int]:
    """The filter's 64-bit words, four to a block, in proportion to the list up to a bound of half a megabyte.

    A list too long for the bound lets more URLs through to the exact join; results stay the same.
    """
    blocks = 1
    while blocks < max_blocks and blocks * 64 * WORDS < keys * bits_per_key:
        blocks *= 2
    words = [F.bit_or(_mask(F.col("key"), k)).alias(f"w{k}") for k in range(WORDS)]
    out = [0] * (blocks * WORDS)
    for r in entries.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*words).toLocalIterator():  # as many rows as blocks
        out[r["block"] * WORDS : (r["block"] + 1) * WORDS] = [r[f"w{k}"] for k in range(WORDS)]
    return out


def holds(words: list[int]):
    """Whether the filter may hold a key, as a function of its Column."""
    filled = F.from_json(F.lit(json.dumps(words)), "array<bigint>")

    def test(key: Column) -> Column:
        first = _block(key, len(words) // WORDS) * WORDS + 1
        found = F.lit(True)
        for k in range(WORDS):
            found = found & (F.element_at(filled, (first + k).cast("int")).bitwiseAND(_mask(key, k)) == _mask(key, k))
        return found

    return test


def judge(pages: DataFrame, listed: DataFrame, url_col: str = "url", id_col: str = "page_id", max_blocks: int = 1 << 14) -> DataFrame:
    """page_id, host, path, rule, verdict and listed (the canonical URL, if in the list); a row for each row of pages.

    listed: key and verdict. A key that begins with `=` is a canonical URL; others are a host and a
    path prefix, such as `net/` or `example.org/es/`, and hold for the host's subdomains too. The
    longest fitting rule decides; without one, a listed canonical URL has its entry's verdict, and
    any other URL is allowed. Of entries with one key the smallest verdict holds. A null URL or one
    without `://` has empty host and path, and fits no rule. Repeated rows and null ids stay as they
    are; other columns are not read; an empty table gives an empty table.
    """
    entries = listed.where("key is not null").groupBy("key").agg(F.min("verdict").alias("verdict"))
    shape = entries.agg(F.count("*").alias("n"), F.collect_set(F.when(~F.col("key").startswith("="), F.length(F.col("key")) - F.instr("key", "/") + 1)).alias("lengths")).first()
    may = holds(filter_blocks(entries, shape["n"], max_blocks=max_blocks))
    rows = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape["lengths"])] or [F.lit(None).cast("string")]), lambda p: p.isNotNull())
    keys = F.concat(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))), F.array(canonical(F.col("host"), F.col("path"))))
    keyed = rows.withColumn("possible", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.filter(keys, may)))
    straight = keyed.where(F.size("possible") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(None).cast("string").alias("listed"))

    asked = keyed.where(F.size("possible") > 0).withColumn("row", F.monotonically_increasing_id())
    asked = asked.select("row", "page_id", "host", "path", F.explode("possible").alias("key"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    exact = asked.select("key").distinct().join(entries, "key").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    hits = asked.join(exact, ["key", "salt"], "left")
    found, is_rule = F.col("verdict").isNotNull(), ~F.col("key").startswith("=")
    best = hits.groupBy("row", "page_id", "host", "path").agg(
        F.max(F.when(found & is_rule, F.struct(F.length("key").alias("n"), "key", "verdict"))).alias("rule"),
        F.max(F.when(found & ~is_rule, F.struct("key", "verdict"))).alias("exact"),
    )
    judged = best.select("page_id", "host", "path", F.col("rule.key").alias("rule"), F.coalesce("rule.verdict", "exact.verdict", F.lit("allow")).alias("verdict"), F.expr("substring(exact.key, 2)").alias("listed"))
    return straight.unionByName(judged)
