"""Mixing sources to target weights, in DataFrame functions only.

Tokens are counted for each source, targets follow from weights, and a document comes floor(rate)
times and once more if a number hashed from it is below the rate's fraction. All further work is on
ids, sources and sizes; no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.portable import text_hash
from assay.llm.shared import SALTS
from assay.operators.rank import rank_by_text
from assay.session import cut

WORDS = r"[^\x20\x09-\x0D]+"
#: Seeds of a source's draws; of all, the one whose draws come nearest to the target is taken.
SEEDS = 32
#: Draws that share a digest, 8 hexadecimal digits each.
_EACH = 4


def sized(docs: DataFrame, *keep: str, source: str = "source", text: str = "text") -> DataFrame:
    """keep, source (as text) and size: the words of each text, none of a null one."""
    return docs.select(*keep, F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))


def targets(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size and target of each source of rows with source and size.

    Sources in order of code points, null last, weigh as `weights`, repeating; targets share `share`
    times all sizes by weight. A target above `most` times its source's size stops there, and the
    excess goes to the others by weight, until none is above: with L for what a weight of 1 gets,
    the target is the smaller of L * weight and most * size. Each round finds L from two sums; there
    are no more rounds than sources, and a few in practice.
    """
    totals = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    named = totals.where("source is not null")
    ranked = rank_by_text(named, "source", []).unionByName(totals.where("source is null").withColumn("rank", F.lit(named.count() + 1)))
    of_rank = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = cut(ranked.select("source", F.col("source_size").cast("long").alias("source_size"), of_rank.alias("weight")))
    full = most * F.col("source_size")
    level, before = 0.0, -1
    while True:
        above = full < level * F.col("weight") if before >= 0 else F.lit(False)
        r = ranked.agg(F.sum(F.when(above, F.col("source_size")).otherwise(0)).alias("stopped"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count_if(above).alias("n"), F.sum("source_size").alias("all")).first()
        if r["n"] == before or not r["open"]:
            break
        level, before = (share * r["all"] - most * r["stopped"]) / r["open"], r["n"]
    # where all have stopped there is no level that would hold any
    return ranked.select("source", "source_size", F.when(F.lit(bool(r["open"])), F.least(full, level * F.col("weight"))).otherwise(full).alias("target"))


def _drawn(seed: Column) -> Column:
    """Whether the draw of a seed is below the fraction: 32 bits of a digest of doc_id and size."""
    digits = F.substr(text_hash(F.floor(seed / _EACH), "doc_id", "size"), (8 * (seed % _EACH) + 1).cast("int"), F.lit(8))
    return F.conv(digits, 16, 10).cast("double") / 4294967296.0 < F.col("fraction")


def _copies() -> Column:
    return (F.col("whole") + F.when(_drawn(F.col("seed")), 1).otherwise(0)).cast("int").alias("copies")


def _met(rows: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """rows with their source's columns: sources are broadcast if there are `most` or fewer, else joined with the rows dealt over salts."""
    if sources.count() <= most:
        right = F.broadcast(sources.withColumnRenamed("source", "_source"))
        return rows.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
    spread = sources.select(F.col("source").alias("_source"), *[c for c in sources.columns if c != "source"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_to"))
    return dealt.join(spread, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_to"))).drop("_source", "_part", "_to")


def rates(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seeds: int = SEEDS, broadcast: int = 1 << 16) -> DataFrame:
    """source, source_size, target, whole and fraction of the rate, and seed, of each source of rows with doc_id, source and size.

    Each source takes the seed, of `seeds`, at which its words come nearest to the target (the
    smallest of equals): all seeds are drawn for each row and summed in one aggregate.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = cut(targets(rows, weights, share, most).withColumn("whole", F.floor(rate)).withColumn("fraction", rate - F.col("whole")))
    tried = _met(rows, wanted.select("source", "fraction"), broadcast).groupBy("source").agg(*[F.sum(F.when(_drawn(F.lit(s)), F.col("size")).otherwise(0)).alias(f"_{s}") for s in range(seeds)])
    best = wanted.join(tried.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    gap = [F.struct(F.abs(F.col("target") - (F.col("whole") * F.col("source_size") + F.col(f"_{s}"))).alias("gap"), F.lit(s).alias("seed")) for s in range(seeds)]
    return cut(best.select(*wanted.columns, F.array_min(F.array(*gap))["seed"].alias("seed")))


def copies(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", broadcast: int = 1 << 16, **how) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of each document (see `targets` and `rates`).

    copies is floor(target / source_size), and one more with the probability of the rest: if a number
    hashed from (seed, doc_id, size) is below it. Rows alike in doc_id and size are drawn alike; a
    null text has no words, a null doc_id is a key like others, null sources are one source. Runs
    agree, however the table is partitioned. broadcast: sources up to which their table is broadcast.
    """
    rows = cut(sized(docs, F.col(id_col).cast("long").alias("doc_id"), source=source, text=text))
    return _met(rows, rates(rows, broadcast=broadcast, **how), broadcast).select("doc_id", "source", "size", "source_size", "target", _copies())


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", broadcast: int = 1 << 16, **how) -> DataFrame:
    """The mixed corpus: every document once for each of its copies, with all its columns."""
    rows = sized(docs, F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), source=source, text=text)
    met = _met(rows, rates(cut(rows.select("doc_id", "source", "size")), broadcast=broadcast, **how), broadcast)
    return met.select("row", F.explode(F.array_repeat(F.lit(0), _copies()))).select("row.*")
