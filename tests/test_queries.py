import pytest
from oracle import differences

import __spark_entry__

SQL = {n: s for n, s in __spark_entry__.oracle_sql().items() if n not in ("p8_texts",)}
FOUND = {
    "p1_found": {"rec_id", "tag", "utc_us"}, "p3_found": {"rec_id", "tag", "pos", "item"}, "p5_found": {"rec_id", "kind", "other_id"}, "p6_found": {"rec_id", "tag", "filled"},
    "p7_found": {"dump_id", "change_kind", "field_name", "new_name"},
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, name):
    assert differences(spark, data, __spark_entry__.queries()[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(FOUND))
def test_found(spark, data, name):
    df = __spark_entry__.queries()[name](spark, data)
    assert set(df.columns) == FOUND[name]
    assert df.count() == df.distinct().count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_without_sql_runs(spark, data):
    for name in ("failing_files", "offset_check", "p6_chained", "p7_table"):
        assert __spark_entry__.queries()[name](spark, data).count() > 0
