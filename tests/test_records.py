"""Records over line ends, read in splits, against Spark's reader that takes whole files."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import loans, records

COLUMNS = ["a", "b", "c", "_extra"]
CELLS = ["", "x", "12", "two words", 'five"inch', '"quoted"', '"with, comma"', '"line\nend"',
         '"two\n\nends"', '"say ""hi"""', '"""', '"\n"', '""', '"a""\n,b"']


def by_whole_file(spark, path):
    return spark.read.schema(", ".join(f"{c} string" for c in COLUMNS)).options(
        multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_extra",
        columnPruning=False).csv(path)


def by_splits(spark, path):
    found = records.records(records.lines(spark, [path], loans.file_uri()))
    shape = ", ".join(f"{c} string" for c in COLUMNS)
    return found.filter("value != ''").select(F.from_csv("value", shape, {
        "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_extra"}).alias("r"),
        ).select("r.*")


def rows(df):
    return sorted((r.a, r.b, r.c) for r in df.na.fill("null").collect())


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in (
        "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [1, 2])
def test_same_rows_as_the_whole_file_reader(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    cells = [c for c in CELLS if c != '"""']
    path = tmp_path / "a.csv"
    path.write_text("".join(
        f"r{k},{rng.choice(cells)},{rng.choice(cells)}\n" for k in range(300)))
    source = records.lines(spark, [str(path)], loans.file_uri())
    assert source.select("block").distinct().count() > 40
    found = by_splits(spark, str(path))
    assert rows(found) == rows(by_whole_file(spark, str(path)))
    assert found.count() == 300


def test_a_record_over_many_blocks_and_several_files(spark, tmp_path, small_splits):
    long = "\n".join("line %d, with a comma" % k for k in range(60))
    for name in ("a.csv", "b c.csv"):
        (tmp_path / name).write_text(f'1,"{long}",x\n2,plain,"{long}"\n3,y,z')
    found = records.records(records.lines(spark, [str(tmp_path)], loans.file_uri()))
    assert found.select("uri").distinct().count() == 2
    got = sorted((r.a, r.b, r.c) for r in by_splits(spark, str(tmp_path)).collect())
    assert got == sorted([("1", long, "x"), ("2", "plain", long), ("3", "y", "z")] * 2)


def test_an_open_quote_takes_the_rest_of_its_file(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('1,x,y\n2,"open,y\n' + "3,x,y\n" * 40)
    found = records.records(records.lines(spark, [str(tmp_path)], loans.file_uri())).collect()
    assert sorted(len(r.value) for r in found)[0] == 5 and len(found) == 2


@pytest.mark.parametrize("line, outside, inside", [
    ("a,b", False, True), ('a,"b', True, False), ('a"b,c', False, False), ('"a,""b', True, False),
    ('end",x', False, False), ('end","next', True, True), ('""', False, True), ("", False, True),
    ('"a"b,c', False, False), ('"x","y', True, True),
])
def test_steps_of_a_line(spark, line, outside, inside):
    row = spark.range(1).select(
        records.opens(F.lit(line)).alias("f0"), records._after_inside(F.lit(line)).alias("f1")).first()
    assert (row.f0, row.f1) == (outside, inside)
