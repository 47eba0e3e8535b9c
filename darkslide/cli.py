"""Command line: get, set and chk on extracted metadata, zone of a place; get where no command is named."""

from __future__ import annotations

import argparse
import json
import sys

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.operators import checks, rules, zones
from darkslide.sources.records import change_set, expand, ordered_json, read_json_records, read_yaml, yaml_text
from darkslide.session import written

COMMANDS = ("get", "set", "chk", "zone", "-h", "--help")


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="darkslide")
    sub = main.add_subparsers(dest="command", required=True)
    steps = [*rules.TRANSFORMATIONS, "check", "ALL"]
    for name in ("get", "set", "chk"):
        one = sub.add_parser(name)
        one.add_argument("files", nargs="+")
        if name != "chk":
            one.add_argument("--transform", "-t", action="append", default=[], choices=steps)
            one.add_argument("--rules")
    place = sub.add_parser("zone", help="the time zone of a place; with --time, its offset and wall time then")
    place.add_argument("lat", type=float)
    place.add_argument("lon", type=float)
    place.add_argument("--zones", required=True, help="a zone table stored by store_zones")
    place.add_argument("--time", help="an instant in UTC, YYYY-MM-DD HH:MM:SS")
    sub.choices["get"].add_argument("--dictify", "-d", action="store_true")
    sub.choices["set"].add_argument("--tags", required=True)
    chk = sub.choices["chk"]
    chk.add_argument("--tolerance_meters", "-m", type=int, default=200)
    chk.add_argument("--dt", action="store_true", help="dates, times and offsets against each other; both checks where none is named")
    chk.add_argument("--geotz", action="store_true", help="offsets against the place, of files without findings of the other check; needs --zones")
    chk.add_argument("--zones", help="a zone table stored by store_zones")
    return main


def _records(spark: SparkSession, files: list[str]) -> DataFrame:
    read = read_json_records(spark, expand(files))
    return read.select("source_file", F.transform("tags", lambda t: F.struct(t["key"].alias("key"), t["value"].alias("value"))).alias("tags"))


def _rules(path: str | None) -> rules.Rules:
    if path is None:
        return rules.Rules()
    return rules.Rules.load(yaml.safe_dump(read_yaml(path), sort_keys=False))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """The exit code: 1 if any checked file fails. Output is by file, one at a time, as the rows come."""
    args = list(sys.argv[1:] if args is None else args)
    if args and args[0] not in COMMANDS:
        args.insert(0, "get")
    said = parser().parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    if said.command == "zone":
        point = spark.createDataFrame([(0, said.lat, said.lon, said.time)], "id int, lat double, lon double, time string").select("id", "lat", "lon", F.col("time").try_cast("timestamp_ntz").alias("utc"))
        found = zones.local_times(point, "id", zones.load_zones(spark, said.zones)).first()
        if found.tz is None:
            print("no zone", file=sys.stderr)
            return 1
        print(found.tz if found.local is None else f"{found.tz} {found.offset_s} {found.local}")
        return 0
    if said.command == "chk":
        if said.geotz and not said.zones:
            parser().error("--geotz needs --zones")
        both = not (said.dt or said.geotz)
        if both and not said.zones:
            print("geotz is not checked: no --zones", file=sys.stderr)
        records = _records(spark, said.files).where(F.col("source_file").endswith(".jpg"))
        values = F.transform("tags", lambda t: F.try_variant_get(t["value"], "$", "string"))
        records = written(records.select(F.monotonically_increasing_id().alias("id"), "source_file", rules.as_map(F.col("tags")).alias("tags"), values.alias("ordered")), "records")
        failed = None
        if both or said.dt:
            found = checks.failing(checks.datetime_findings(records, keep=["id", "source_file"]))
            failed = written(found.select("id", "source_file", F.to_json(checks.findings_by_severity(F.col("findings"))).alias("f")), "findings")
        if said.zones and (both or said.geotz):
            rest = records if failed is None else records.join(failed.select("id"), "id", "left_anti")
            rows = rest.select("id", F.inline(F.array(checks.offset_facts(F.col("tags"), F.col("ordered")))))
            wrong = zones.check_offsets(rows, "id", zones.load_zones(spark, said.zones), said.tolerance_meters).where("error_class in ('TzMismatchError', 'ValueError')")
            of_place = wrong.join(records.select("id", "source_file"), "id").select("id", "source_file", F.to_json(F.create_map("error_class", "error")).alias("f"))
            failed = of_place if failed is None else failed.unionByName(of_place)
        code = 0
        for row in failed.orderBy("id").toLocalIterator():
            print(yaml.safe_dump({row.source_file: json.loads(row.f)}, sort_keys=False, allow_unicode=True).strip())
            code = 1
        return code
    names = [*rules.TRANSFORMATIONS, "check"] if "ALL" in said.transform else said.transform
    if said.command == "set":
        files = spark.createDataFrame([(f,) for f in expand(said.files)], "source_file string")
        tags = yaml.safe_load(said.tags)
        if names:
            given = F.array(*[F.struct(F.lit(k).alias("key"), F.parse_json(F.lit(json.dumps(v, ensure_ascii=False))).alias("value")) for k, v in tags.items()])
            done = rules.transform_records(spark.range(1).select(given.alias("tags")), _rules(said.rules), names).first()
            tags = {t.key: json.loads(t.value.toJson()) for t in done.tags}
            for text in done.asDict().get("unequal") or []:
                print(text, file=sys.stderr)
        for row in change_set(files, tags).toLocalIterator():
            print(json.dumps(row.asDict(), ensure_ascii=False))
        return 0
    done = rules.transform_records(_records(spark, said.files), _rules(said.rules), names)
    # A pattern may stand for several files.
    many = said.dictify or len(expand(said.files)) > 1
    for row in done.select("source_file", yaml_text(ordered_json(F.col("tags"))).alias("text")).toLocalIterator():
        print(yaml.safe_dump({row.source_file: yaml.safe_load(row.text)}, sort_keys=False, allow_unicode=True).strip() if many else row.text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
