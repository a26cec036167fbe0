"""Incremental points equal the batch points over the same files."""

from pyspark.sql import functions as F

from tallyframe.operators import series
from tallyframe.operators.prepare import prepare
from tallyframe.roles import Roles
from tallyframe.streaming.points import read_points, start_points_stream

SCHEMA = "day string, shop string, income string, cost string"
ROLES = Roles(date="day", revenue="income", expense="cost")


def _write(folder, name, rows):
    (folder / name).write_text("day,shop,income,cost\n" + "\n".join(",".join(r) for r in rows) + "\n")


def test_stream_matches_batch(spark, tmp_path):
    src, sink, ck = tmp_path / "in", tmp_path / "points", tmp_path / "ck"
    src.mkdir()
    _write(src, "a.csv", [("01.01.2026", "x", "100", "10"), ("02.01.2026", "y", "50", "")])
    _write(src, "b.csv", [("01.01.2026", "y", "30", "5")])
    q = start_points_stream(spark, str(src), SCHEMA, ROLES, str(sink), keys=["shop"],
                            checkpoint_location=str(ck))
    q.awaitTermination(120)
    _write(src, "c.csv", [("02.01.2026", "x", "70", "7"), ("03.01.2026", "x", '"1 000,50"', "n/a")])
    q = start_points_stream(spark, str(src), SCHEMA, ROLES, str(sink), keys=["shop"],
                            checkpoint_location=str(ck))
    q.awaitTermination(120)
    got = {(r.shop, str(r.period.date())): (r.revenue, r.expenses, r.rows)
           for r in read_points(spark, str(sink), ROLES, ["shop"]).collect()}
    assert got == {("x", "2026-01-01"): (100.0, 10.0, 1), ("y", "2026-01-02"): (50.0, 0.0, 1),
                   ("y", "2026-01-01"): (30.0, 5.0, 1), ("x", "2026-01-02"): (70.0, 7.0, 1),
                   ("x", "2026-01-03"): (1000.5, 0.0, 1)}
    full = spark.read.option("header", "true").schema(SCHEMA).csv(str(src))
    batch = series.time_series(prepare(full, ROLES, ["shop"]), "day")
    assert batch.agg(F.sum("revenue")).first()[0] == sum(v[0] for v in got.values())


def test_batches_decide_together(spark, tmp_path):
    """A dirty cell in one batch changes how another batch's cells are read, as in one table."""
    src, sink, ck = tmp_path / "in", tmp_path / "points", tmp_path / "ck"
    src.mkdir()
    roles = Roles(date=["alt", "day"], amount="income")
    schema = "day string, alt string, shop string, income string"
    for name, rows in (("a.csv", [("01.01.2026", "-", "x", "1.234"), ("01.01.2026", "-", "y", "1.234")]),
                       ("b.csv", [("02.01.2026", "05.05.2026", "x", "n/a")])):
        (src / name).write_text("day,alt,shop,income\n" + "\n".join(",".join(r) for r in rows) + "\n")
        q = start_points_stream(spark, str(src), schema, roles, str(sink), keys=["shop"], checkpoint_location=str(ck))
        q.awaitTermination(120)
    got = {(r.shop, str(r.period.date())): r.amount for r in read_points(spark, str(sink), roles, ["shop"]).collect()}
    # x: cleaned by the dirty cell (a thousands mark), dated by the column that batch b makes valid
    assert got == {("x", "2026-05-05"): 0.0, ("y", "2026-01-01"): 1.234}
    full = spark.read.option("header", "true").schema(schema).csv(str(src))
    batch = series.time_series(prepare(full, roles, ["shop"]), "day")
    assert {(r.shop, str(r.period.date())): r.amount for r in batch.collect()} == got
