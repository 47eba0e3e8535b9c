"""The whole corpus as token ids of a public tokenizer, and back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from darkslide.llm.bpe import TOKENIZERS, encoder
from darkslide.session import spread


def encode_texts(df: DataFrame, id_column: str, text_column: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Rows (id, ids) of every row of df: the token ids of its text, without special tokens, whose names in a text are ordinary text.

    Null and empty texts have an empty list. Whole texts are encoded; rows with the same id stay rows of their own; a null id stays; other columns are dropped.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, folder)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=[id_column, "ids"])

    rows = spread(df.select(id_column, text_column))
    return rows.mapInArrow(encode, f"{id_column} {rows.dtypes[0][1]}, ids array<int>")


def count_tokens(df: DataFrame, id_column: str, text_column: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Rows (id, tokens): as encode_texts, the numbers only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, folder)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(own.encode(t)) for t in b.column(1).to_pylist()], pa.int64())], names=[id_column, "tokens"])

    rows = spread(df.select(id_column, text_column))
    return rows.mapInArrow(count, f"{id_column} {rows.dtypes[0][1]}, tokens bigint")


def decode_ids(df: DataFrame, id_column: str, ids_column: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Rows (id, text): the texts of token ids by concatenating the vocabulary's strings; "" for none, null for null."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, folder)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else own.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=[id_column, "text"])

    rows = spread(df.select(id_column, ids_column))
    return rows.mapInArrow(decode, f"{id_column} {rows.dtypes[0][1]}, text string")
