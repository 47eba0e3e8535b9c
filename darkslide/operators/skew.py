"""Joins to a lookup table in which one key may stand in a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds over 1 / HOT_SHARE of the counted rows; there can't be more than HOT_SHARE of them, which bounds the broadcast.
HOT_SHARE = 2_000


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, weight: str, how: str = "inner", spread_by: str | None = None) -> DataFrame:
    """rows joined to lookup (unique in key, a written table) on key.

    weight is lookup's column with the number of rows behind each key. Hot keys, at most HOT_SHARE by definition, are
    broadcast; the others shuffle, and each has at most 1 / HOT_SHARE of the rows. Rows with a null key find nothing:
    "inner" drops them, "left" keeps them with nulls and, with those of hot keys, spreads them by the column spread_by;
    "inner" spreads by the other columns where spread_by isn't given.
    """
    total = lookup.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > max(1, total / HOT_SHARE)
    values = [c for c in lookup.columns if c not in (key, weight)]
    near = F.broadcast(lookup.where(hot).select(key, F.struct(F.lit(True).alias("_"), *values).alias("_near")))
    cold = lookup.where(~hot)
    marked = rows.join(near, key, "left")
    if how not in ("inner", "left") or how == "left" and spread_by is None:
        raise ValueError("how must be inner, or left with spread_by")
    # rows are read once: those that the shuffled join has nothing for are spread by what is in them.
    plain = [c for c, kind in rows.dtypes if not kind.startswith(("map", "variant", "array", "struct")) and c != key]
    spread_out = F.xxhash64(spread_by) if spread_by else F.xxhash64(*(plain or [key]))
    away = F.when(F.col(key).isNull() | F.col("_near").isNotNull(), F.concat(F.lit("\u0000"), spread_out.cast("string"))).otherwise(F.col(key).cast("string"))
    far = cold.select(F.col(key).cast("string").alias("_away"), F.struct(F.lit(True).alias("_"), *values).alias("_far"))
    joined = marked.withColumn("_away", away).join(far, "_away", "left")
    if how == "inner":
        joined = joined.where(F.col("_near").isNotNull() | F.col("_far").isNotNull())
    return joined.select(*rows.columns, *[F.when(F.col("_near").isNotNull(), F.col("_near")[c]).otherwise(F.col("_far")[c]).alias(c) for c in values])
