"""Pieces that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geoledger.operators.storage import drop_path, materialize, scratch_path, shared_dir

__all__ = ["drop_path", "materialize", "scratch_path", "shared_dir", "table", "broadcast_small", "join_small", "SPACES"]

#: The six characters of [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"

#: A table is broadcast only when it was counted and has at most so many rows.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_small(df: DataFrame, most: int = 16 << 20) -> DataFrame:
    """A written table, to be broadcast if its rows have at most ``most`` bytes as text; else Spark joins it by sorting."""
    size = df.agg(F.sum(F.length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def join_small(big: DataFrame, small: DataFrame, keys: list[str], salt: Column, salts: int = 64) -> DataFrame:
    """Left join to a table with unique non-null keys that is usually small.

    ``small`` is counted first (it should be materialized). Up to BROADCAST_ROWS rows it is
    broadcast. Beyond that, rows of ``big`` are salted and ``small`` is repeated once per salt,
    so that one hot key is dealt to ``salts`` tasks. That join is sorted and merged: Spark knows the
    size of ``small``'s files only, and would broadcast all its copies.
    """
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, "left")
    salted = big.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    spread = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted.join(spread.hint("merge"), [*keys, "_salt"], "left").drop("_salt")
