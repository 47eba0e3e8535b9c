"""How often every distinct term occurs, in how many records, and whether that makes it useful."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkslide.llm.suffixes import intervals
from darkslide.operators.packed import split_array
from darkslide.session import ship, written

RARE_BELOW = 3
COMMON_SHARE = 20

_COUNTS = "gram array<string>, occurrences bigint, records bigint"


def term_of(item: str) -> str:
    """The term an item stands for: lower case, composed, single spaces."""
    return " ".join(unicodedata.normalize("NFC", unicodedata.normalize("NFC", item).lower()).split())


def batch_terms(batch: pa.RecordBatch, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The record (row) and term code of every item of a batch, by row, field and position; and the terms by code."""
    found = [split_array(batch.column(c)) for c in columns]
    items = pa.concat_arrays([x[0] for x in found])
    encoded = items.dictionary_encode()
    terms = [term_of(x) for x in encoded.dictionary.to_pylist()]
    names = {t: i for i, t in enumerate(dict.fromkeys(terms))}
    codes = np.array([names[t] for t in terms], np.int64)[encoded.indices.to_numpy()] if len(items) else np.zeros(0, np.int64)
    rows = np.concatenate([x[1] for x in found])
    order = np.argsort(rows, kind="stable")
    rows, codes = rows[order], codes[order]
    if "" in names:
        kept = codes != names[""]
        rows, codes = rows[kept], codes[kept]
    return rows, codes, list(names)


def count_terms(df: DataFrame, id_column: str, columns: Sequence[str], max_n: int = 1) -> DataFrame:
    """Rows (gram, occurrences, records) of every n-gram of up to max_n consecutive terms, and one with an empty gram, of the records with any term.

    A suffix array is built over each batch of records and its intervals are merged by gram: a record is wholly in one
    batch, so its count needs no record ids beyond it. Rows equal in id and columns count as one record; null and
    blank texts hold no term; with several columns their terms follow each other. Other columns are ignored.
    """
    ship(df.sparkSession)
    columns = list(columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("gram", pa.list_(pa.string())), ("occurrences", pa.int64()), ("records", pa.int64())])
        for batch in batches:
            rows, codes, terms = batch_terms(batch, columns)
            if not len(rows):
                continue
            yield pa.RecordBatch.from_arrays([pa.array([[]], pa.list_(pa.string())), pa.array([len(rows)]), pa.array([len(np.unique(rows))])], schema=schema)
            names = pa.array(terms, pa.string())
            for n, at, occurrences, records in intervals(codes, rows, max_n):
                flat = codes[(at[:, None] + np.arange(n)).ravel()]
                grams = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n, dtype=np.int32)), names.take(pa.array(flat)))
                yield pa.RecordBatch.from_arrays([grams, pa.array(occurrences), pa.array(records)], schema=schema)

    records = df.select(id_column, *columns).where(F.coalesce(*columns).isNotNull()).distinct()
    return records.mapInArrow(count, _COUNTS).groupBy("gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(df: DataFrame, id_column: str, columns: Sequence[str], max_n: int = 1, rare_below: int = RARE_BELOW, common_share: int = COMMON_SHARE) -> DataFrame:
    """Rows (gram, occurrences, records, mark): rare below rare_below records, common above one common_share-th of the records with any term, else useful.

    An empty table and one without terms give no rows.
    """
    counts = written(count_terms(df, id_column, columns, max_n), "terms")
    whole = (counts.where(F.size("gram") == 0).agg(F.max("records")).first() or [0])[0] or 0
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * common_share > F.lit(whole), "common").otherwise("useful")
    return counts.where(F.size("gram") > 0).withColumn("mark", mark)
