import statistics

from darkslide.functions.paths_text import directory_of
from darkslide.operators.impute import chained_imputation, days_and_offsets, strict_modes


def test_directories():
    same = {directory_of(p) for p in ("photos/2009/01/Őá b/x.jpg", "./photos/2009/01/Őá b/y.jpg", "/mnt/a/photos//2009/01/Őá b/x.jpg", "D:\\photos\\2009\\01\\Őá b\\x.jpg", "PHOTOS/2009/01/ŐÁ B/X.JPG", "file:///srv/photos/2009/01/%C5%90%C3%A1%20b/x.jpg", "photos/2009/01/Őá b/z")}
    assert same == {"photos/2009/01/őá b"}
    assert directory_of(None) is directory_of(" ") is directory_of("x.jpg") is None
    assert directory_of("photos/100%25/x") == "photos/100%25"


def test_modes_and_ties(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", None), (None, "x")], "g string, v string")
    assert [tuple(r) for r in strict_modes(df, "g", "v").collect()] == [("a", "x", 3)]


def test_days_and_offsets_filled(spark):
    p = "photos/2009/01/03/s/"
    rows = [(1, p + "1.jpg", "2009:01:03 10:00:00", "+01:00", 0), (1, p + "1.jpg", "2009:01:03 10:00:00", "+01:00", 1), (2, "./" + p + "2.jpg", "    :  :     :  :  ", "n/a", 0), (3, p + "3.jpg", "1231176813", None, 0), (4, p + "4.jpg", "2009:02:31 00:00:00", "+1", 0), (5, None, None, None, 0), (6, "photos/q/6.jpg", None, None, 0)]
    df = spark.createDataFrame(rows, "rec_id bigint, f string, d string, o string, directory int")
    seen = days_and_offsets(df, "rec_id", "f", "d", "o")
    found = {r.rec_id: r for r in chained_imputation(seen, "rec_id", ["directory"], ["day", "offset"]).collect()}
    assert len(found) == 6
    assert (found[2].day, found[2].day_filled, found[2].day_level, found[2].offset) == ("2009-01-03", True, "directory", "+01:00")
    assert (found[3].day, found[3].day_filled, found[3].offset, found[3].offset_filled) == (None, False, "+01:00", True)
    assert (found[4].day, found[4].offset_filled, found[1].day_filled) == ("2009-01-03", False, False)
    assert found[5].day_level is None and found[6].day is None
    assert chained_imputation(seen.limit(0), "rec_id", ["directory"], ["day", "offset"]).count() == 0


def test_numeric_keeps_spread_and_observed(spark):
    import random

    rng = random.Random(1)
    rows = []
    for i in range(600):
        x = rng.gauss(0, 1)
        rows.append((i, x, None if i % 3 == 0 else 2 * x + 1 + rng.gauss(0, 0.5), "k"))
    df = spark.createDataFrame(rows, "id bigint, x double, y double, y_filled_note string")
    found = {r.id: r for r in chained_imputation(df, "id", [], numeric=["x", "y"]).collect()}
    assert all(found[i].y == rows[i][2] and not found[i].y_filled for i in range(600) if i % 3)
    residuals = [found[i].y - (2 * rows[i][1] + 1) for i in range(0, 600, 3)]
    assert all(found[i].y_filled for i in range(0, 600, 3)) and abs(statistics.mean(residuals)) < 0.15 and 0.35 < statistics.stdev(residuals) < 0.65
    empty = spark.createDataFrame([(1, None, None)], "id bigint, x double, y double")
    assert tuple(chained_imputation(empty, "id", [], numeric=["x", "y"]).first())[1] is None


def test_numeric_by_group_and_category(spark):
    import random

    rng = random.Random(2)
    rows = []
    for i in range(1200):
        g, c, x = rng.randrange(6), rng.choice("pq"), rng.gauss(0, 1)
        y = 10 * g + (4 if c == "q" else 0) + x + rng.gauss(0, 0.5)
        rows.append((i, None if i % 50 == 0 else f"g{g}", c, x, y if i % 3 else None, g))
    df = spark.createDataFrame(rows, "id bigint, g string, kind string, x double, y double, true_g int")
    found = {r.id: r for r in chained_imputation(df, "id", ["g"], ["kind"], ["x", "y"]).collect()}
    gaps = [r for r in rows if r[4] is None and r[1] is not None]
    residuals = [found[r[0]].y - (10 * r[5] + (4 if r[2] == "q" else 0) + r[3]) for r in gaps]
    assert abs(statistics.mean(residuals)) < 0.3 and 0.35 < statistics.stdev(residuals) < 0.8
    # Without a group, any may be the one.
    assert statistics.stdev(found[r[0]].y for r in rows if r[4] is None and r[1] is None) > 5


def test_noise_groups_have_no_effect_and_numbers_classify(spark):
    import random

    rng = random.Random(3)
    rows = [(i, f"g{i // 3}", None if i % 4 == 0 else ("low" if i % 100 < 50 else "high"), float(i % 100), None if i % 3 == 0 else rng.gauss(5, 1)) for i in range(900)]
    df = spark.createDataFrame(rows, "id bigint, g string, kind string, x double, y double")
    found = {r.id: r for r in chained_imputation(df, "id", [], ["kind"], ["x", "y"]).collect()}
    assert all(found[i].kind == ("low" if i % 100 < 50 else "high") and found[i].kind_level == "field:x" for i in range(0, 900, 4))
    filled = [r.y for r in chained_imputation(df, "id", ["g"], [], ["y"]).collect() if r.y_filled]
    assert 4.7 < statistics.mean(filled) < 5.3 and 0.8 < statistics.stdev(filled) < 1.2
