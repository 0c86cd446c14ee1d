"""What the operators share: table access, word patterns and written intermediates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.settings import scratch_folder

WORD = r"[^\x20\x09-\x0D]+"    # words are parted by ASCII white space only


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder, so that lost executors replay nothing before it."""
    path = scratch_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


SIEVE = 27    # 2 ** SIEVE bits, 16 MB, at any size of the input


def sieve(keys: DataFrame) -> DataFrame:
    """A bit per value of the long column ``key``: (bucket, bits), 4 KB per bucket, 2 ** SIEVE bits at most."""
    spot = F.col("key").bitwiseAND(F.lit((1 << SIEVE) - 1))
    return keys.select(F.shiftright(spot, 15).alias("bucket"), spot.bitwiseAND(F.lit(32767)).alias("bit")) \
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def sifted(rows: DataFrame, key: str, bits: DataFrame, flag: str) -> DataFrame:
    """``rows`` with ``flag``: false where the long column ``key`` has none of the sieve's keys for certain.

    The sieve's size is fixed, so it is broadcast; it only spares a join that decides afterwards.
    """
    spot = F.col(key).bitwiseAND(F.lit((1 << SIEVE) - 1))
    byte = F.conv(F.hex(F.expr(f"substring(__bits, int((`{key}` & 32767) div 8) + 1, 1)")), 16, 10).cast("long")
    named = bits.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
    return rows.join(F.broadcast(named), F.shiftright(spot, 15) == F.col("__bucket"), "left") \
        .withColumn(flag, F.coalesce(F.getbit(byte, F.col(key).bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))).drop("__bucket", "__bits")


def bounds_of(lengths) -> np.ndarray:
    """Where each of adjoining stretches starts, and where the last one ends."""
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


class Store:
    """Lists of ids, one behind the other."""

    def __init__(self):
        self.ids, self.bounds, self.n = np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Append lists of these lengths, given one behind the other."""
        first = int(self.bounds[self.n])
        if first + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty(first + len(ids), np.int32)))
        if self.n + len(lengths) >= len(self.bounds):
            self.bounds = np.concatenate((self.bounds, np.empty(self.n + len(lengths), np.int64)))
        self.ids[first:first + len(ids)] = ids
        self.bounds[self.n + 1:self.n + 1 + len(lengths)] = first + np.cumsum(lengths, dtype=np.int64)
        self.n += len(lengths)

    def cut(self, n: int) -> None:
        """Forget all lists but the first ``n``."""
        self.n = n

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the lists at ``places``, and the bounds of these lists."""
        starts = self.bounds[places]
        lengths = self.bounds[places + 1] - starts
        bounds = bounds_of(lengths)
        return self.ids[np.repeat(starts - bounds[:-1], lengths) + np.arange(bounds[-1])], bounds
