"""Documents put into containers of fixed capacity with as little unused space as possible."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkslide.llm.grouping import evolve
from darkslide.session import written

CAPACITY = 2_048
#: Items of one block, which its islands pack; islands of a block; rounds, with migration of the elite between them.
BLOCK, ISLANDS, EPOCHS = 4_000, 2, 2
#: Containers of a block filled less than this are opened, and what was in them is packed together with that of other blocks.
GOOD = 0.995


def fill_containers(df: DataFrame, id_column: str, size_column: str, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Rows (id, piece, size, container): every row of df, whole or, above capacity, in pieces of which all but the last are of just the capacity.

    Items are spread over blocks; islands evolve packings of a block by the grouping genetic algorithm and pass their best on;
    the best is kept, and its badly filled containers go into the next level, of fewer blocks, until one is left. piece counts from 0. Sizes of 0 and null (taken as 0)
    take no space but have a container. Rows with the same id are items of their own. An empty table gives no rows.
    """
    kind = dict(df.dtypes)[id_column]
    size = F.greatest(F.coalesce(F.col(size_column), F.lit(0)).cast("bigint"), F.lit(0))
    sized = df.select(F.col(id_column).alias("id"), size.alias("size"))
    pieces = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)) - 1)
    items = sized.select("id", F.explode(pieces).alias("piece"), "size")
    items = items.select("id", "piece", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("bigint").alias("size"))
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "items")
    full = items.where(F.col("size") == capacity)
    done = [full.select("item", F.concat(F.lit("full-"), F.col("item").cast("string")).alias("container"))]
    rest, left, level = items.where(F.col("size") < capacity).select("item", "size"), None, 0
    while True:
        number = rest.count()
        blocks = -(-number // block)
        if not number:
            break
        packed = _pack(rest, blocks, capacity, islands, epochs, level)
        name = F.concat_ws("-", F.lit(str(level)), F.col("block").cast("string"), F.col("bin").cast("string")).alias("container")
        loads = packed.groupBy("block", "bin").agg(F.sum("size").alias("load"))
        again = packed.join(loads, ["block", "bin"])
        good = F.col("load") >= GOOD * capacity
        bins, bad = loads.agg(F.count("*"), F.count(F.when(~good, 1))).first()
        # Levels go on for as long as they save containers.
        if blocks == 1 or left is not None and bins >= left:
            done.append(packed.select("item", name))
            break
        done.append(again.where(good).select("item", name))
        rest, left, level = again.where(~good).select("item", "size"), bad, level + 1
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    out = items.join(found, "item").select(F.col("id").alias(id_column), "piece", "size", "container")
    assert dict(out.dtypes)[id_column] == kind
    return out


def _island(epoch: int, level: int, capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Evolves the packing of one island, from its own and its neighbour's best of the epoch before."""

    def evolve_group(group: pd.DataFrame) -> pd.DataFrame:
        own = group[group["role"] == 0].sort_values("item")
        sizes = own["size"].to_numpy()
        elites = []
        if epoch:
            elites.append(own["bin"].to_numpy())
            elites += [g.sort_values("item")["bin"].to_numpy() for _, g in group[group["role"] > 0].groupby("role")]
        seed = int(own["block"].iloc[0]) * 1_000_003 + int(own["island"].iloc[0]) * 1_009 + epoch * 31 + level
        best = evolve(sizes, capacity, seed, elites)
        return pd.DataFrame({"block": own["block"], "island": own["island"], "item": own["item"], "size": sizes, "bin": best.bin_of.astype(np.int64), "bins": len(best.loads), "fill": best.fitness(capacity)[1]})

    return evolve_group


def _pack(rest: DataFrame, blocks: int, capacity: int, islands: int, epochs: int, level: int) -> DataFrame:
    """Rows (item, size, block, bin) of the best island of each block, written."""
    spread = rest.select("item", "size", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(blocks)).alias("block"))
    state = spread.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(0).alias("role"), "item", "size", F.lit(-1).cast("bigint").alias("bin"))
    schema = "block bigint, island int, item bigint, size bigint, bin bigint, bins bigint, fill double"
    for epoch in range(epochs):
        evolved = written(state.groupBy("block", "island").applyInPandas(_island(epoch, level, capacity), schema), "islands")
        state = evolved.select("block", "island", F.lit(0).alias("role"), "item", "size", "bin")
        if islands > 1:
            state = state.unionByName(evolved.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.lit(1).alias("role"), "item", "size", "bin"))
    best = evolved.groupBy("block").agg(F.min(F.struct("bins", (-F.col("fill")).alias("f"), "island")).alias("b")).select("block", F.col("b.island").alias("island"))
    return written(evolved.join(best, ["block", "island"]).select("item", "size", "block", "bin"), "packed")
