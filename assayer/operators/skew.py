"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_KEYS = 10_000
SPREAD = 1024


def attach_by_key(df: DataFrame, table: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join of a per-key table that carries ``pos_n``, the rows of ``df`` with the key.

    A key with more than a ``HOT_KEYS``-th of all counted rows is hot; there can be at
    most ``HOT_KEYS`` of them, so they are broadcast.  All other keys go through an
    ordinary shuffle join, and rows already served are spread over salts there, where
    they match nothing.
    """
    keys, columns = list(keys), list(columns)
    plain = [f"_k{i}" for i in range(len(keys))]
    counted = table.agg(F.sum("pos_n")).scalar()
    hot_row = F.col("pos_n") * F.lit(HOT_KEYS) > F.coalesce(counted, F.lit(0))
    hot = table.filter(hot_row).select(
        *[F.col(k).alias(p) for k, p in zip(keys, plain)],
        *[F.col(c).alias(f"_hot_{c}") for c in columns],
        F.lit(True).alias("_hot"),
    )
    cold = table.filter(~hot_row).select(
        *[F.col(k).alias(p) for k, p in zip(keys, plain)],
        F.lit(0).alias("_salt"),
        *[F.col(c).alias(f"_cold_{c}") for c in columns],
    )
    on_hot = [F.col(k) == F.col(p) for k, p in zip(keys, plain)]
    served = df.join(F.broadcast(hot), on_hot, "left").drop(*plain)
    # salts depend on the row alone, so a repeated task places its rows as before
    hashed = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    salted = served.withColumn(
        "_salt",
        F.when(F.col("_hot"), 1 + F.pmod(F.xxhash64(*hashed), F.lit(SPREAD)).cast("int")).otherwise(F.lit(0)),
    )
    on_cold = [*on_hot, salted["_salt"] == cold["_salt"]]
    joined = salted.join(cold, on_cold, "left")
    return joined.select(
        *[F.col(c) for c in df.columns if c not in columns],
        *[F.coalesce(F.col(f"_hot_{c}"), F.col(f"_cold_{c}")).alias(c) for c in columns],
    )
