"""Pairs of terms that stand in the same records: exact counts, and how much they exceed chance."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkslide.llm.nullmodel import ConfigurationNull
from darkslide.llm.terms import batch_terms
from darkslide.operators.skew import lookup_join
from darkslide.session import ship, small_enough, written

MIN_TOGETHER = 10
MIN_RATIO = 3
#: Pairs that are put together before they are counted and handed on; bounds a task's memory, not the result.
CHUNK = 1_000_000
#: Width of the bins in which p-values are ranked, of log(1 - log10 p): 0.00002 powers of ten at p = 1, 0.0002 at 1e-10, 0.002 at 1e-100. Their number grows with the logarithm of the deepest one only.
BIN = 0.00002
#: Pairs above which a basket is made into several tasks' work.
SPLIT = 8 * CHUNK


def baskets_of(df: DataFrame, id_column: str, columns: Sequence[str]) -> DataFrame:
    """One row per record with any term: terms, an array of its distinct ones over all columns."""
    ship(df.sparkSession)
    columns = list(columns)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, codes, terms = batch_terms(batch, columns)
            if not len(rows):
                continue
            both = np.unique(rows * len(terms) + codes)
            rows, codes = both // len(terms), both % len(terms)
            starts = np.concatenate([[0], np.cumsum(np.bincount(rows)[np.unique(rows)])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(terms, pa.string()).take(pa.array(codes)))
            yield pa.RecordBatch.from_arrays([lists], names=["terms"])

    return df.select(id_column, *columns).where(F.coalesce(*columns).isNotNull()).distinct().mapInArrow(collect, "terms array<string>")


def _pairs_in_chunks(codes: np.ndarray, starts: np.ndarray, slices: np.ndarray | None = None, own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within each basket, by baskets of one size together; a basket of any size goes through in chunks. Of one in several slices only the pairs of every slices-th item, from own on."""
    sizes = np.diff(starts)
    slices, own = (np.ones_like(sizes), np.zeros_like(sizes)) if slices is None else (slices, own)
    for base, k, n, first in zip(starts[:-1][slices > 1], sizes[slices > 1], slices[slices > 1], own[slices > 1]):
        for i in range(int(first), int(k) - 1, int(n)):
            rest = codes[base + i + 1 : base + k]
            yield np.full(len(rest), codes[base + i]), rest
    sizes = np.where(slices > 1, 0, sizes)
    for k in np.unique(sizes[sizes > 1]):
        of_size = starts[:-1][sizes == k]
        if k * (k - 1) // 2 <= CHUNK:
            i, j = np.triu_indices(int(k), 1)
            at_once = max(1, CHUNK // len(i))
            for b in range(0, len(of_size), at_once):
                base = of_size[b : b + at_once, None]
                yield codes[(base + i).ravel()], codes[(base + j).ravel()]
        else:
            for base in of_size:
                for i in range(int(k) - 1):
                    rest = codes[base + i + 1 : base + k]
                    yield np.full(len(rest), codes[base + i]), rest


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, together) with a < b, counted over chunks."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    number = 0

    def give() -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held))
        low, high = np.minimum(a, b), np.maximum(a, b)
        names = np.unique(np.concatenate([low, high]))
        code, count = np.unique(np.searchsorted(names, low) * len(names) + np.searchsorted(names, high), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(names[code // len(names)]), pa.array(names[code % len(names)]), pa.array(count.astype(np.int64))], names=["a", "b", "together"])

    for batch in batches:
        lists = batch.column("ids")
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        slices, own = (batch.column(c).to_numpy() for c in ("slices", "slice"))
        for pair in _pairs_in_chunks(lists.flatten().to_numpy(), starts, slices, own):
            held.append(pair)
            number += len(pair[0])
            if number >= 2 * CHUNK:
                yield give()
                held, number = [], 0
    if number:
        yield give()


def surprising_pairs(df: DataFrame, id_column: str, columns: Sequence[str], min_together: int = MIN_TOGETHER, min_ratio: int = MIN_RATIO) -> DataFrame:
    """Rows (term_a, term_b, together, n_a, n_b, expected, log10_p, q_value) of every pair in min_together or more records and min_ratio or more times as often as chance; with 1 and 0, of every pair that stands together at all.

    q_value is Benjamini-Hochberg's over all pairs of all terms, from ranks in bins of p: every pair is counted and judged,
    and the two limits only choose among the rows then, so they change no value of a row. Pairs that never stand
    together have p = 1. The rest is as in judged_pairs.
    """
    judged, number, whole = _judged(df, id_column, columns, 1, 0)
    return _with_q(judged, number * (number - 1) // 2).where((F.col("together") >= min_together) & _exceeds(whole, min_ratio)) if whole else judged.withColumn("q_value", F.lit(None).cast("double"))


def judged_pairs(df: DataFrame, id_column: str, columns: Sequence[str], min_together: int = MIN_TOGETHER, min_ratio: int = MIN_RATIO) -> DataFrame:
    """Rows as of surprising_pairs without q_value, which needs all pairs: here those beyond the limits aren't counted.

    together, n_a and n_b are exact. A term in fewer than min_together records, or in more than one min_ratio-th of
    them, is in no such pair whatever its partners are, so these are left out before pairs are formed. expected and log10_p are of the configuration model fitted to the term frequencies
    and basket sizes. Rows equal in id and columns are one record; null and blank texts hold no term; an
    empty table gives no rows.
    """
    return _judged(df, id_column, columns, min_together, min_ratio)[0]


def _exceeds(whole: int, min_ratio: int) -> Column:
    big = lambda c: F.col(c).cast("decimal(19,0)")
    return big("together") * F.lit(whole).cast("decimal(19,0)") >= F.lit(min_ratio) * big("n_a") * big("n_b")


def _judged(df: DataFrame, id_column: str, columns: Sequence[str], min_together: int, min_ratio: int) -> tuple[DataFrame, int, int]:
    """judged_pairs, the number of terms that can be in them, and of records with any term."""
    baskets = written(baskets_of(df, id_column, columns), "baskets")
    spark = df.sparkSession
    whole = baskets.count()
    sizes = {r[0]: r[1] for r in baskets.groupBy(F.size("terms")).count().collect()}
    counts = written(baskets.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")), "term-counts")
    degrees = {r[0]: r[1] for r in counts.groupBy("n").count().collect()}
    able = written(counts.where((F.col("n") >= min_together) & (F.col("n") * min_ratio <= whole)).withColumn("id", F.monotonically_increasing_id()), "able-terms")
    number = able.count()
    if small_enough(number):
        held = spark.sparkContext.broadcast(able.select("term", "id").toArrow())

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, ids = held.value.column("term").combine_chunks(), held.value.column("id").to_numpy()
            for batch in batches:
                lists = batch.column("terms")
                found = pc.index_in(lists.flatten(), names)
                known = pc.is_valid(found).to_numpy(zero_copy_only=False)
                rows = pc.list_parent_indices(lists).to_numpy()[known]
                starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(lists)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(starts), pa.array(ids[found.drop_null().to_numpy()]))], names=["ids"])

        coded = baskets.mapInArrow(code, "ids array<bigint>")
    else:
        rows = baskets.withColumn("basket", F.monotonically_increasing_id()).select("basket", F.explode("terms").alias("term"))
        coded = lookup_join(rows, able, "term", "n").groupBy("basket").agg(F.collect_list("id").alias("ids")).select("ids")
    coded = coded.where(F.size("ids") > 1)
    n = F.size("ids").cast("bigint")
    slices = (n * (n - 1) / 2 / SPLIT).cast("int") + 1
    if max(sizes, default=0) ** 2 / 2 > SPLIT:
        # Slices of a large basket go to tasks of their own.
        coded = written(coded.withColumn("slices", slices), "coded")
        large = coded.where("slices > 1").select("ids", "slices", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        coded = coded.where("slices = 1").select("ids", "slices", F.lit(0).alias("slice")).unionByName(large.repartition(F.xxhash64("ids"), F.col("slice")))
    else:
        coded = coded.select("ids", F.lit(1).alias("slices"), F.lit(0).alias("slice"))
    pairs = coded.mapInArrow(_count_pairs, "a bigint, b bigint, together bigint").groupBy("a", "b").agg(F.sum("together").alias("together")).where(F.col("together") >= min_together)
    side = F.broadcast(able) if small_enough(number) else able
    for x in "ab":
        pairs = pairs.join(side.select(F.col("id").alias(x), F.col("term").alias(f"term_{x}"), F.col("n").alias(f"n_{x}")), x)
    pairs = pairs.where(_exceeds(whole, min_ratio))
    flip = F.col("term_a") > F.col("term_b")
    pairs = pairs.select(*[F.when(flip, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("term_a", "term_b"), ("term_b", "term_a"))], "together", *[F.when(flip, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("n_a", "n_b"), ("n_b", "n_a"))])
    if not whole:
        return pairs.select("*", *[F.lit(None).cast("double").alias(c) for c in ("expected", "log10_p")]), number, whole
    null = spark.sparkContext.broadcast(ConfigurationNull(sizes, degrees))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, t = (batch.column(c).to_numpy() for c in ("n_a", "n_b", "together"))
            if len(t):
                # Rare pairs mostly share their three numbers, each of which is judged once.
                (low, high, each), at = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), t]), axis=1, return_inverse=True)
                expected, log_p = (x[at.ravel()] for x in null.value.tails(low, high, each))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected), pa.array(log_p / math.log(10))], names=[*batch.schema.names, "expected", "log10_p"])

    judged = written(pairs.mapInArrow(judge, "term_a string, term_b string, together bigint, n_a bigint, n_b bigint, expected double, log10_p double"), "pairs")
    return judged, number, whole


def _with_q(judged: DataFrame, tests: int) -> DataFrame:
    """Benjamini-Hochberg: the least of p x tests / rank over the pairs at least as unlikely, ranks by bins of log p, all of a bin counting as its largest. Below 1e-300 it is 0 where floating point has no such number."""
    spark = judged.sparkSession
    bin_of = F.floor(F.log(1 - F.least("log10_p", F.lit(0.0))) / BIN).cast("int")
    counts = sorted(((r[0], r[1]) for r in judged.groupBy(bin_of.alias("bin")).count().collect()), reverse=True)
    rank, values = 0, []
    for b, n in counts:
        rank += n
        values.append(min(0.0, 1 - math.exp(b * BIN) + math.log10(tests / rank)))
    for i in range(len(values) - 2, -1, -1):
        values[i] = min(values[i], values[i + 1])
    levels = spark.createDataFrame([(b, 10.0**v) for (b, _), v in zip(counts, values)], "bin int, q_value double")
    return judged.withColumn("bin", bin_of).join(F.broadcast(levels), "bin", "left").drop("bin")
