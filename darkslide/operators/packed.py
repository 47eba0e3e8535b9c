"""Several values packed in one field: one row per value, with its position.

Vectorised over whole Arrow batches: separators and quotes become masks over the UTF-8 buffer, quote parity drops the
separators within quotes, child offsets are built from what is left, and the list array is flattened with the ordinals
of its parents. Only texts whose quotes don't alternate plainly, and JSON lists, are read one by one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from darkslide.session import ship

# The separators. A slash separates only between two spaces.
SEPARATORS = (",", ";", "|", "\n", "\r", "\t", "，", "、", "；", "·")
QUOTES = ('"', "'")

_SINGLE = np.zeros(256, bool)
_SINGLE[[ord(s) for s in SEPARATORS if s.isascii()]] = True
_LONGER = [np.frombuffer(s.encode(), np.uint8) for s in SEPARATORS if not s.isascii()]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x0B, 0x0C]] = True


def split_text(text: str) -> list[str]:
    """The items of one text: what the vectorised scan must give, and its fallback where quotes don't alternate plainly."""
    if (items := _json_list(text)) is not None:
        return items
    return [x for a, b, quote in _cut(text) if (x := _plain(text[a:b], quote))]


def _json_list(text: str) -> list[str] | None:
    stripped = text.strip()
    if not (stripped.startswith("[") and stripped.endswith("]")):
        return None
    try:
        found = json.loads(stripped)
    except ValueError:
        return None
    texts = (x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False) for x in found)
    return [x.strip() for x in texts if x.strip()]


def _is_separator(text: str, i: int) -> bool:
    return text[i] in SEPARATORS or text[i] == "/" and text[i - 1 : i] == " " and text[i + 1 : i + 2] == " "


def _cut(text: str) -> list[tuple[int, int, str]]:
    """Start, end and quote of each item; without a quote, the item may have white space around it."""
    spaces, n, out, i = " \v\f", len(text), [], 0
    while i <= n:
        start = i
        while i < n and text[i] in spaces:
            i += 1
        if i < n and text[i] in QUOTES and (end := _closing(text, i)) >= 0:
            out.append((i + 1, end, text[i]))
            i = end + 1
            while i < n and not _is_separator(text, i):
                i += 1
        else:
            while i < n and not _is_separator(text, i):
                i += 1
            out.append((start, i, ""))
        i += 1
    return out


def _closing(text: str, at: int) -> int:
    """Index of the quote that closes the one at at, -1 if none does: a quote that is neither doubled nor escaped, with a separator or the end behind it."""
    quote, n, i = text[at], len(text), at + 1
    while i < n:
        if text[i] == "\\":
            i += 2
        elif text[i] != quote:
            i += 1
        elif text[i + 1 : i + 2] == quote:
            i += 2
        else:
            j = i + 1
            while j < n and text[j] in " \v\f":
                j += 1
            if j >= n or _is_separator(text, j):
                return i
            i += 1
    return -1


def _plain(item: str, quote: str) -> str:
    if quote:
        out, i = [], 0
        while i < len(item):
            if item[i] == "\\" and item[i + 1 : i + 2] in ("\\", quote) or item[i] == quote and item[i + 1 : i + 2] == quote:
                i += 1
            out.append(item[i])
            i += 1
        item = "".join(out)
    return item.strip()


def split_array(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The items of a string array, with the index of the text each comes from and its position there from 1. Null and empty texts have none."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(texts) and texts.buffers()[2] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    stripped = pc.utf8_trim_whitespace(texts)
    slow = (pc.and_(pc.starts_with(stripped, "["), pc.ends_with(stripped, "]"))).to_numpy(zero_copy_only=False).copy()
    items, parents = _scan(data, offsets, slow)
    if slow.any():
        apart = [(int(i), x) for i in np.flatnonzero(slow) for x in split_text(texts[int(i)].as_py())]
        items = pa.concat_arrays([items, pa.array([x for _, x in apart], pa.large_string())])
        parents = np.concatenate([parents, np.array([i for i, _ in apart], np.int64)])
        order = np.argsort(parents, kind="stable")
        items, parents = items.take(pa.array(order)), parents[order]
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(parents, minlength=len(texts)))]), pa.int64()), items)
    parents = pc.list_parent_indices(lists).to_numpy()
    starts = np.frombuffer(lists.buffers()[1], np.int64)[: len(texts) + 1]
    return lists.flatten(), parents, np.arange(len(parents)) - starts[parents] + 1


def _scan(data: np.ndarray, offsets: np.ndarray, slow: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Items and parents of the texts not marked slow; marks those, too, that need the text-by-text way."""
    n = len(data)
    if not n:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)
    first, last = offsets[:-1][row], offsets[1:][row]
    at = np.arange(n)
    size = _SINGLE[data].astype(np.int64)
    for mark in _LONGER:
        hit = data[: n - len(mark) + 1] == mark[0] if n >= len(mark) else np.zeros(0, bool)
        for k in range(1, len(mark)):
            hit = hit & (data[k : n - len(mark) + 1 + k] == mark[k])
        size[np.flatnonzero(hit)] = len(mark)
    slash = np.flatnonzero(data == 0x2F)
    slash = slash[(slash > first[slash]) & (slash + 1 < last[slash])]
    size[slash[(data[slash - 1] == 0x20) & (data[slash + 1] == 0x20)]] = 1
    cut = np.flatnonzero(size)

    quoted = np.zeros(n, bool)
    opens = np.zeros(n, bool)
    quote = (data == 0x22) | (data == 0x27)
    if quote.any():
        # What stands before and behind, white space skipped.
        solid = ~_SPACE[data]
        before = np.concatenate([[-1], np.maximum.accumulate(np.where(solid, at, -1))[:-1]])
        behind = np.concatenate([np.minimum.accumulate(np.where(solid, at, n)[::-1])[::-1][1:], [n]])
        ends = np.zeros(n, bool)  # last byte of a separator
        ends[cut + size[cut] - 1] = True
        q = np.flatnonzero(quote)
        opening = q[(before[q] < first[q]) | ends[before[q]] & (before[q] >= first[q])]
        closing = q[(behind[q] >= last[q]) | (size[np.minimum(behind[q], n - 1)] > 0) & (behind[q] < last[q])]
        odd_rows = np.zeros(len(lengths), bool)
        odd_rows[row[np.flatnonzero(data == 0x5C)]] = True  # a backslash
        double = np.flatnonzero((data[:-1] == data[1:]) & quote[:-1] & (row[:-1] == row[1:]))
        odd_rows[row[double]] = True
        events = np.concatenate([opening * 2, closing * 2 + 1])
        events.sort(kind="stable")
        where, closes = events // 2, (events & 1).astype(bool)
        nth = np.arange(len(where)) - np.searchsorted(row[where], row[where])
        wrong = closes != (nth & 1).astype(bool)
        pair = np.flatnonzero(closes[1:] & ~closes[:-1])
        wrong[pair] |= (data[where[pair]] != data[where[pair + 1]]) | (where[pair] == where[pair + 1])
        wrong |= closes & (nth == 0)
        if len(where):
            ends_open = np.flatnonzero(np.concatenate([row[where[1:]] != row[where[:-1]], [True]]) & ~closes)
            wrong[ends_open] = True
        has_opening = np.zeros(len(lengths), bool)
        has_opening[row[opening]] = True
        odd_rows[row[where[wrong]]] = True
        slow |= odd_rows & has_opening
        good = has_opening[row[where]] & ~slow[row[where]]
        o, c = where[good & ~closes], where[good & closes]
        step = np.zeros(n + 1, np.int32)
        step[o] += 1
        step[c + 1] -= 1
        quoted = np.cumsum(step[:-1]) > 0  # parity: odd within quotes
        opens[o] = True
        cut = cut[~quoted[cut]]

    cut = cut[~slow[row[cut]]]
    rows = np.flatnonzero(~slow & (lengths > 0))
    parents = np.concatenate([rows, row[cut]])
    starts = np.concatenate([offsets[:-1][rows], cut + size[cut]])
    order = np.lexsort((starts, parents))
    starts, parents = starts[order], parents[order]
    stops = np.sort(np.concatenate([offsets[1:][rows], cut]), kind="stable")
    # White space at both ends, then enclosing quotes.
    solid_at = np.flatnonzero(~_SPACE[data])
    if not len(solid_at):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    k = np.searchsorted(solid_at, starts)
    begin = np.minimum(np.where(k < len(solid_at), solid_at[np.minimum(k, len(solid_at) - 1)], n), stops)
    k = np.searchsorted(solid_at, stops) - 1
    finish = np.maximum(np.where(k >= 0, solid_at[np.maximum(k, 0)] + 1, 0), begin)
    enclosed = (begin < stops) & opens[np.minimum(begin, n - 1)]
    begin, finish = begin + enclosed, finish - enclosed
    kept = finish > begin
    begin, finish, parents = begin[kept], finish[kept], parents[kept]
    step = np.zeros(n + 1, np.int32)
    step[begin] += 1
    step[finish] -= 1
    child = np.concatenate([[0], np.cumsum(finish - begin)])
    items = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(child.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[np.cumsum(step[:-1]) > 0])))
    items = pc.utf8_trim_whitespace(items)
    some = pc.greater(pc.utf8_length(items), 0).to_numpy(zero_copy_only=False)
    return (items, parents) if some.all() else (items.filter(pa.array(some)), parents[some])


def split_packed(df: DataFrame, fields: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """One row per item: the columns keep, tag (the key of fields), pos from 1 within the text, and item.

    Null, blank and empty texts, texts of separators only and empty tables give no rows. Rows equal in keep and the
    fields count once, so a record delivered again doesn't repeat its items. Other columns of df are dropped. A column of keep may not be called tag, pos or item.
    """
    if clash := {"tag", "pos", "item"} & set(keep):
        raise ValueError(f"columns to keep are named like results: {sorted(clash)}")
    ship(df.sparkSession)
    columns = list(dict.fromkeys([*keep, *fields.values()]))
    rows = df.select(*columns).where(F.coalesce(*[F.col(c) for c in fields.values()]).isNotNull()).distinct()
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("tag", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("item", T.StringType())])
    named, kept = dict(fields), list(keep)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tag, column in named.items():
                items, parents, pos = split_array(batch.column(column))
                if len(items):
                    above = pa.array(parents)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).take(above) for c in kept), pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(items), np.int32)), pa.array([tag])).cast(pa.string()), pa.array(pos.astype(np.int32)), items.cast(pa.string())],
                        names=[*kept, "tag", "pos", "item"],
                    )

    return rows.mapInArrow(split, schema)
