"""Exact duplicates by two-pass Bloom filtering, in DataFrame functions only.

First pass: each text's hash sets `hashes` bits of one word of a Bloom filter; what is kept is the
filter of bits set more than once. Second pass: a row all of whose bits are in it is possibly
repeated; only those rows shuffle, by the SHA-256 of their text, and the rest pass straight through.
Groups come from partial aggregates, and a large group's rows are dealt over parts to meet theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.shared import cut, looked_up


def filter_words(rows: int, bits_per_row: int = 16, max_words: int = 1 << 20) -> int:
    """64-bit words of the filter: in proportion to the rows up to a bound on what is broadcast.

    Beyond the bound more unrepeated rows pass for possibly repeated and are shuffled too; results
    stay the same.
    """
    words = 1
    while words < max_words and words * 64 < rows * bits_per_row:
        words *= 2
    return words


def _bits(h: Column, hashes: int) -> Column:
    """The bits that a hash sets in its word."""
    mask = F.lit(0).cast("long")
    for k in range(hashes):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", h, F.lit(58 - 6 * k)).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def repeated_filter(hashed: DataFrame, words: int, hashes: int) -> DataFrame:
    """word, bits: the bits that two rows or more set."""
    bit = [F.call_function("shiftrightunsigned", F.col("h"), F.lit(58 - 6 * k)).bitwiseAND(F.lit(63)).cast("int") for k in range(hashes)]
    cell = hashed.select(F.pmod("h", F.lit(words)).alias("word"), F.explode(F.array_distinct(F.array(*bit))).alias("bit"))
    often = cell.groupBy("word", "bit").agg(F.count("*").alias("n")).where("n > 1")
    return often.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))


def mark_duplicates(docs: DataFrame, hashes: int = 3, bits_per_row: int = 16, max_words: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; a row for each row of docs.

    Texts are equal if identical; null counts as empty. Of equal texts the row of the largest
    doc_id stays, and one only if rows repeat it. A null doc_id is smaller than all others; of a
    group of only such rows one stays, and keep_id is null. Other columns are not read; an empty
    table gives an empty table. row_col, if given, holds unique longs, which come along as `row`.
    """
    number = F.monotonically_increasing_id() if row_col is None else F.col("row")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([] if row_col is None else [F.col(row_col).alias("row")]))
    words = filter_words(docs.count(), bits_per_row, max_words)
    repeated = repeated_filter(rows.select(F.xxhash64("text").alias("h")), words, hashes)
    # at most max_words rows of 16 bytes, whatever the input
    hashed = rows.select(*rows.drop("text").columns, F.sha2("text", 256).alias("text_sha256"), F.xxhash64("text").alias("h"))
    mask = _bits(F.col("h"), hashes)
    probed = hashed.withColumn("word", F.pmod("h", F.lit(words))).join(F.broadcast(repeated), "word", "left")
    maybe = F.coalesce(F.col("bits"), F.lit(0).cast("long")).bitwiseAND(mask) == mask
    # written once, without the texts, so that a row has the same number wherever it is read
    probed = cut(probed.select("doc_id", "text_sha256", maybe.alias("maybe"), number.alias("row")))
    out = ("doc_id", "keep_id", "group_size", "kept", "text_sha256", *(() if row_col is None else ("row",)))
    repeats = probed.where("maybe").drop("maybe")
    groups = repeats.groupBy("text_sha256").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row")).alias("last"), F.count("*").alias("group_size"))
    groups = groups.select("text_sha256", F.col("last.doc_id").alias("keep_id"), F.col("last.row").alias("keep_row"), "group_size")
    resolved = looked_up(repeats, groups, "text_sha256", "row").withColumn("kept", F.col("row") == F.col("keep_row")).select(*out)
    straight = probed.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *out[4:])
    return straight.unionByName(resolved)
