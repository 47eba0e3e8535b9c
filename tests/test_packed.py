import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from darkslide.operators.packed import split_array, split_packed, split_text


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("a, b;c|d", ["a", "b", "c", "d"]), ("", []), (" , ;", []), ('"a, b", c', ["a, b", "c"]), ("24/7 / x", ["24/7", "x"]), ('kék 7" single, y', ['kék 7" single', "y"]), ('"7"" single";z', ['7" single', "z"]),
        ("'o''clock', p", ["o'clock", "p"]), ("o'clock tower, q", ["o'clock tower", "q"]), ('["a", "b, c", "\\u00e9"]', ["a", "b, c", "é"]), ("[]", []), ("[x", ["[x"]), ("a，b、c · d·e", ["a", "b", "c", "d", "e"]), ('"open, b', ['"open', "b"]),
        ("half-timbered, misc.", ["half-timbered", "misc."]), ("a\r\nb\tc", ["a", "b", "c"]), ('""', []), ("\xa0x\xa0,y", ["x", "y"]), ("öreg (old), [b]", ["öreg (old)", "[b]"]),
    ],
)
def test_items(text, items):
    assert split_text(text) == items
    assert split_array(pa.array([text]))[0].to_pylist() == items


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from(list("ab ,;|\"'·，/\\[]é\n\t")), max_size=14), max_size=12))
def test_vectorised_scan_equals_text_by_text(texts):
    items, parents, pos = split_array(pa.array(texts, pa.string()))
    expected = [(i, p, x) for i, t in enumerate(texts) if t for p, x in enumerate(split_text(t), 1)]
    assert list(zip(parents.tolist(), pos.tolist(), items.to_pylist())) == expected


def test_rows(spark):
    rows = [(1, "a, b", None, "x"), (1, "a, b", None, "y"), (2, None, "c;c", "x"), (3, "", "", None), (None, "d", "d", None), (4, "z," * 50_000, None, None)]
    df = spark.createDataFrame(rows, "id bigint, k string, s string, tag string")
    found = split_packed(df, {"K": "k", "S": "s"}, ["id"])
    small = sorted((str(r.id), r.tag, r.pos, r.item) for r in found.where("id <> 4 or id is null").collect())
    assert small == [("1", "K", 1, "a"), ("1", "K", 2, "b"), ("2", "S", 1, "c"), ("2", "S", 2, "c"), ("None", "K", 1, "d"), ("None", "S", 1, "d")]
    assert found.where("id = 4").count() == 50_000
    assert split_packed(df.limit(0), {"K": "k"}, ["id"]).count() == 0
    with pytest.raises(ValueError):
        split_packed(df, {"K": "k"}, ["tag"])
