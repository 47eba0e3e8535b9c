"""Missing values filled from similar records by chained equations, with marks of what was filled."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkslide.functions.paths_text import directory_of
from darkslide.functions.stamps import offset_minutes, offset_text, written_day
from darkslide.operators.skew import lookup_join
from darkslide.session import ship, written


def strict_modes(rows: DataFrame, key: str, field: str) -> DataFrame:
    """Rows (key, mode, n): the value strictly more frequent than any other among the non-null ones of field, by non-null key.

    Counted before anything is gathered, so a key with a third of all rows is no burden; a tie has no mode and no row.
    """
    counts = rows.where(F.col(key).isNotNull() & F.col(field).isNotNull()).groupBy(key, field).agg(F.count("*").alias("c"))
    # The largest and the smallest of the most frequent values are the same exactly if there is one.
    tops = counts.groupBy(key).agg(F.max(F.struct("c", field)).alias("high"), F.min(F.struct((-F.col("c")).alias("c"), field)).alias("low"), F.sum("c").alias("n"))
    return tops.where(F.col(f"high.{field}") == F.col(f"low.{field}")).select(key, F.col(f"high.{field}").alias("mode"), "n")


def _deviate(id_column: str, field: str, round_: int, seed: int) -> Column:
    """A standard normal deviate fixed by the record, so that a repeated task gives the same."""
    unit = lambda k: (F.pmod(F.xxhash64(F.col(id_column), F.lit(f"{field}/{round_}/{seed}/{k}")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * np.pi * unit(1))


def _regression(state: DataFrame, target: str, y: Column, others: Sequence[str]) -> tuple[list[float], float, int] | None:
    """Coefficients, intercept first, residual deviation and rows of y on others over those where target is observed: sums of products only, one row to the driver."""
    x = [F.lit(1.0), *[F.col(o) for o in others]]
    cells = [F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]
    row = state.where(F.col(f"_seen_{target}")).agg(F.count("*"), F.sum(y * y), *[F.sum(v * y) for v in x], *cells).first()
    if not row[0]:
        return None
    k = len(x)
    xy, xx, flat = np.array(row[2 : 2 + k], float), np.zeros((k, k)), iter(row[2 + k :])
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = float(next(flat))
    beta = np.linalg.lstsq(xx + 1e-9 * np.eye(k) * max(1.0, np.trace(xx) / k), xy, rcond=None)[0]
    rest = max(0.0, float(row[1]) - 2 * float(beta @ xy) + float(beta @ xx @ beta)) / max(1, row[0] - k)
    return [float(b) for b in beta], float(np.sqrt(rest)), row[0]


def _effects(state: DataFrame, target: str, level: str, residual: Column) -> tuple[DataFrame, float, float]:
    """Random effects of level's values on target: rows (level, _effect, _unsure, n), the variance among values, and the degrees of freedom used.

    A value's mean residual is shrunk by the variances within and among values (moments of the analysis of variance), so values with few
    rows, or without any bearing on target, have little effect. _unsure is the variance that a value's effect still has.
    """
    seen = state.where(F.col(f"_seen_{target}") & F.col(level).isNotNull())
    sums = written(seen.groupBy(level).agg(F.count("*").alias("n"), F.avg(residual).alias("_mean"), F.coalesce(F.var_samp(residual), F.lit(0.0)).alias("_var")), "effects")
    n, mean = F.col("n").cast("double"), F.col("_mean")
    groups, rows, squares, total, between, within = sums.agg(F.count("*"), F.sum(n), F.sum(n * n), F.sum(n * mean), F.sum(n * mean * mean), F.sum((n - 1) * F.col("_var"))).first()
    among = inner = 0.0
    if groups > 1 and rows > groups:
        inner = within / (rows - groups)
        among = max(0.0, (between - total * total / rows - (groups - 1) * inner) / (rows - squares / rows))
    share = n * among / (n * among + inner) if among else F.lit(0.0)
    found = sums.select(level, (share * mean).alias("_effect"), ((1 - share) * among).alias("_unsure"), "n")
    used = sums.agg(F.sum(share)).first()[0] or 0.0
    return found, among, used


#: Bins, of equal numbers of observed rows, in which numeric fields enter classifiers.
BINS = 10


def _bins(state: DataFrame, fields: Sequence[str]) -> dict[str, Column]:
    """For numeric fields with any observed value, the number of the bin a row's value as it stands is in."""
    if not fields:
        return {}
    cuts = state.agg(*[F.percentile_approx(F.when(F.col(f"_seen_{f}"), F.col(f)), [i / BINS for i in range(1, BINS)], 10_000).alias(f) for f in fields]).first()
    return {f: sum(((F.col(f"_now_{f}") > c).cast("int") for c in sorted(set(cuts[f]))), F.lit(0)) for f in fields if cuts[f]}


def chained_imputation(df: DataFrame, id_column: str, groups: Sequence[str], categorical: Sequence[str] = (), numeric: Sequence[str] = (), rounds: int = 2, seed: int = 0) -> DataFrame:
    """df's id and groups, and for each field its value, <field>_filled and <field>_level.

    Each round fits every incomplete field from the others as they stand: a categorical one by a classifier of strict
    modes, by the first of the groups that has one, then by each other categorical field, then by each numeric field in bins (level "field:<name>"); a numeric one by linear regression on the other numeric fields
    with random effects of the groups and categorical fields, which each round fits anew with those of the last as a start, with a normal
    residual added so that filling doesn't shrink the spread (level "regression"). Fits use observed values only;
    observed values never change, and <field>_filled keeps the mask. A value that no classifier determines stays null and unfilled, as does a numeric field never observed. A boolean column <field>_missing, if df
    has it, says what is missing, else nulls are: a null that isn't missing is neither fitted nor filled.
    Null groups match nothing. An empty table gives no rows; repeated ids are rows of their own.
    """
    fields = [*categorical, *numeric]
    missing = {f: F.col(f"{f}_missing") if f"{f}_missing" in df.columns else F.col(f).isNull() for f in fields}
    state = df.select(id_column, *groups, *[F.col(f).cast("double").alias(f) if f in numeric else f for f in fields], *[missing[f].alias(f"_gap_{f}") for f in fields])
    state = state.select("*", *[(F.col(f).isNotNull() & ~F.col(f"_gap_{f}")).alias(f"_seen_{f}") for f in fields], *[F.lit(None).cast("string").alias(f"{f}_level") for f in fields])
    state = written(state, "impute")
    if numeric:
        means = state.agg(*[F.avg(F.when(F.col(f"_seen_{f}"), F.col(f))).alias(f) for f in numeric]).first()
        state = state.select("*", *[F.coalesce(f, F.lit(means[f]), F.lit(0.0)).alias(f"_now_{f}") for f in numeric])
        levels = [*groups, *[c for c in categorical if c not in groups]]
        state = state.select("*", *[F.lit(0.0).alias(f"_{part}_{f}_{i}") for f in numeric for i in range(len(levels)) for part in ("effect", "unsure")])
    for round_ in range(rounds):
        for f in categorical:
            found = F.lit(None).cast("struct<mode:string,level:string>")
            bins = _bins(state, numeric)
            state = state.select("*", *[b.alias(f"_bin_{o}") for o, b in bins.items()])
            for level in [*groups, *[c for c in categorical if c != f], *[f"_bin_{o}" for o in bins]]:
                observed = state.where(F.col(f"_seen_{f}"))
                modes = written(strict_modes(observed, level, f).withColumnRenamed("mode", f"_m_{level}"), "modes")
                state = lookup_join(state, modes, level, "n", "left", spread_by=id_column)
                name = level if level in groups else f"field:{level.removeprefix('_bin_')}"
                found = F.coalesce(found, F.when(F.col(f"_m_{level}").isNotNull(), F.struct(F.col(f"_m_{level}").cast("string").alias("mode"), F.lit(name).alias("level"))))
            gap = F.col(f"_gap_{f}")
            kind = df.schema[f].dataType
            marks = [c for c in state.columns if c.startswith("_m_")]
            state = state.withColumn("_found", F.when(gap, found)).withColumn(f, F.when(gap, F.col("_found.mode").cast(kind)).otherwise(F.col(f))).withColumn(f"{f}_level", F.when(gap, F.col("_found.level"))).drop("_found", *marks, *[f"_bin_{o}" for o in bins])
            state = written(state, "impute")
        for f in numeric:
            others = [f"_now_{o}" for o in numeric if o != f]
            effects = [F.col(f"_effect_{f}_{i}") for i in range(len(levels))]
            if (fit := _regression(state, f, F.col(f) - sum(effects, F.lit(0.0)), others)) is None:
                continue
            (constant, *slopes), spread, rows = fit
            line = F.lit(constant) + sum((F.col(o) * b for o, b in zip(others, slopes)), F.lit(0.0))
            used = 0.0
            for i, level in enumerate(levels):
                rest = F.col(f) - line - sum((e for j, e in enumerate(effects) if j != i), F.lit(0.0))
                found, among, freedom = _effects(state, f, level, rest)
                used += freedom
                # A value of which nothing is known may have any effect.
                state = lookup_join(state.drop(f"_effect_{f}_{i}", f"_unsure_{f}_{i}"), found, level, "n", "left", spread_by=id_column)
                state = state.withColumn(f"_effect_{f}_{i}", F.coalesce("_effect", F.lit(0.0))).withColumn(f"_unsure_{f}_{i}", F.coalesce("_unsure", F.lit(among))).drop("_effect", "_unsure")
            guess = line + sum(effects, F.lit(0.0))
            if levels:
                state = written(state, "impute")
                # Rows without a group vary by its effect, too, so they tell the rest only where there are no others.
                known = [F.col(level).isNotNull() for level in levels]
                wrong, unsure = (F.col(f) - guess) ** 2, sum((F.col(f"_unsure_{f}_{i}") for i in range(len(levels))), F.lit(0.0))
                whole = reduce(and_, known)
                squares, number, loose = state.where(F.col(f"_seen_{f}")).agg(F.sum(F.when(whole, wrong)), F.count(F.when(whole, 1)), F.sum(wrong - unsure)).first()
                free = len(others) + 1 + used
                spread = float(np.sqrt(squares / (number - free) if number > free else max(0.0, loose) / max(1.0, rows - free)))
            guess += F.sqrt(F.lit(spread**2) + sum((F.col(f"_unsure_{f}_{i}") for i in range(len(levels))), F.lit(0.0))) * _deviate(id_column, f, round_, seed)
            state = state.withColumn(f"_now_{f}", F.when(F.col(f"_gap_{f}"), guess).otherwise(F.col(f"_now_{f}"))).withColumn(f"{f}_level", F.when(F.col(f"_gap_{f}"), F.lit("regression")))
        if numeric:
            state = written(state, "impute")
    value = lambda f: F.when(F.col(f"_gap_{f}") & F.col(f"{f}_level").isNotNull(), F.col(f"_now_{f}")).otherwise(F.col(f)).alias(f) if f in numeric else F.col(f)
    return state.select(id_column, *groups, *[c for f in fields for c in (value(f), F.col(f"{f}_level").isNotNull().alias(f"{f}_filled"), f"{f}_level")])


@lru_cache(100_000)
def _offset(text: str) -> str | None:
    minutes = offset_minutes(text)
    return None if minutes is None else offset_text(minutes)


@lru_cache(100_000)
def _directory(path: str) -> str | None:
    return directory_of(path)


def days_and_offsets(records: DataFrame, id_column: str, path: str, stamp: str, offset: str) -> DataFrame:
    """Rows (id, directory, day, day_missing, offset, offset_missing) of the records, copies once.

    day is the calendar day as written; it is missing where the stamp is null, blank, a placeholder or no date of the
    calendar, while a number of seconds has no day but isn't missing. offset is ±HH:MM, missing where there is none.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = [_directory(x) if x is not None else None for x in b.column(1).to_pylist()]
            days = [written_day(x) for x in b.column(2).to_pylist()]
            offsets = [_offset(x) if x is not None else None for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(places, pa.string()), pa.array([x or None for x in days], pa.string()), pa.array([x is None for x in days]), pa.array(offsets, pa.string()), pa.array([x is None for x in offsets])],
                names=[id_column, "directory", "day", "day_missing", "offset", "offset_missing"],
            )

    ship(records.sparkSession)
    rows = records.select(id_column, path, stamp, offset).distinct()
    return rows.mapInArrow(read, f"{id_column} {rows.dtypes[0][1]}, directory string, day string, day_missing boolean, offset string, offset_missing boolean")
