"""Results of a run kept by what they depend on, so that another run fits only what is absent."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fingerprint(df: DataFrame) -> str:
    """A hash of a table's columns and rows, in whatever order these are, from one aggregate."""
    names = sorted(df.columns)
    cell = lambda c: F.to_json(F.struct(F.col(f"`{c}`"))) if isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)) else F.col(f"`{c}`")
    rows = [F.xxhash64(F.lit(seed), *map(cell, names)) for seed in (1, 2)]
    found = df.agg(F.count("*"), *[F.bit_xor(h) for h in rows], *[F.sum(F.shiftright(h, 24).cast("decimal(38,0)")) for h in rows]).first()
    return hashlib.sha256(json.dumps([[f"{n} {df.schema[n].dataType.simpleString()}" for n in names], [str(x) for x in found]]).encode()).hexdigest()


class Store:
    """A folder of tables by key; one counts as there once it is wholly written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def key(self, spec, *more) -> str:
        """The hash of a candidate but for its name, and of what else a result depends on."""
        own = {k: v for k, v in asdict(spec).items() if k != "name"}
        return hashlib.sha256(json.dumps([own, *more], sort_keys=True, default=str).encode()).hexdigest()

    def has(self, kind: str, key: str) -> bool:
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{key}/_SUCCESS")
        return done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done)

    def table(self, kind: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of a key: as it was kept, or made and kept now."""
        path = f"{self.path}/{kind}/{key}"
        if not self.has(kind, key):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
