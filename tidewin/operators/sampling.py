"""Deterministic sampling: quotas per stratum, caps per group, holdouts by key."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sample_strata(df: DataFrame, strata: list[str], fraction: float, identity: list[str], seed: int = 0) -> DataFrame:
    """max(1, round(n * fraction)) rows of each stratum, those with the smallest seeded hash of ``identity``."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*strata))
    at = F.row_number().over(Window.partitionBy(*strata).orderBy(F.xxhash64(F.lit(seed), *identity), *identity))
    return df.withColumns({"_n": n, "_at": at}).filter(F.col("_at") <= F.greatest(F.lit(1), F.bround(F.col("_n") * fraction))).drop("_n", "_at")


def cap_per_group(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_at") <= most).drop("_at")


def holdout(df: DataFrame, key: str, fraction: float, seed: int = 0, out: str = "held_out") -> DataFrame:
    """Adds ``out``: whether the row's key falls in the held-out share. Rows of a key stay together; nothing is shuffled."""
    return df.withColumn(out, F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(fraction * 1_000_000))


def text_hash(seed: int, *identity: str) -> Column:
    """32 hexadecimal digits of a seed and an identity, which other engines give as well."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity]))


def sample_capped(df: DataFrame, keys: list[str], identity: list[str], most: int, seed: int = 0) -> DataFrame:
    """``most`` rows of each key at most, drawn without replacement: those with the least ``text_hash`` of ``identity``.

    The limit reaches the tasks before the shuffle, so a key of any size sends ``most`` rows a task at most.
    """
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(text_hash(seed, *identity), *identity))
    return df.withColumn("_at", at).filter(F.col("_at") <= most).drop("_at")


def holdout_groups(df: DataFrame, key: str, fraction: float, seed: int = 0, out: str = "held_out") -> DataFrame:
    """Adds ``out``: whether the row's key is held out, by the first eight digits of its ``text_hash``. A null key isn't."""
    share = F.conv(F.substring(text_hash(seed, key), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return df.withColumn(out, F.col(key).isNotNull() & (share < fraction))


def round_robin(df: DataFrame, n: int, order: list[str], keys: list[str] | None = None, out: str = "shard") -> DataFrame:
    """Adds ``out``: the row's place in its key's order modulo n."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*(keys or [])).orderBy(*order)) - 1) % n)


def hash_folds(df: DataFrame, k: int, identity: list[str], keys: list[str], seed: int = 0, out: str = "fold") -> DataFrame:
    """Adds ``out``: places in a seeded random order of each key's rows, modulo k; folds differ by one row at most."""
    w = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *identity), *identity)
    return df.withColumn(out, (F.row_number().over(w) - 1) % k)


def cap_by(df: DataFrame, keys: list[str], order: list[str], cap) -> DataFrame:
    """The first rows of each key, as many as ``cap`` (a column; NULL: all) says."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumns({"_at": at, "_cap": cap}).filter(F.col("_cap").isNull() | (F.col("_at") <= F.col("_cap"))).drop("_at", "_cap")
