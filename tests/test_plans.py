"""Plan-shape guards for the scale properties (checked on the physical plan)."""

import pytest

from tests.conftest import SF001
from tallyframe.plans.registry import QUERIES, load_all

load_all()


def plan(spark, name):
    df = QUERIES[name](spark, SF001)
    return df._jdf.queryExecution().executedPlan().toString()


def test_keyed_anomalies_scan_ledger_once(spark):
    p = plan(spark, "q_anomalies_keyed")
    assert p.count("FileScan parquet") == 1
    assert "SortMergeJoin" not in p and "BroadcastHashJoin" not in p


def test_forecast_scans_once(spark):
    assert plan(spark, "q_forecast_errors").count("FileScan parquet") == 1


def test_keyed_top_k_is_window_group_limit(spark):
    p = plan(spark, "q_top_categories_keyed")
    assert "WindowGroupLimit" in p


def test_single_ledger_top_k_is_take_ordered(spark):
    p = plan(spark, "q_top_categories")
    assert "TakeOrderedAndProject" in p or "TakeOrdered" in p


def test_rollup_is_one_scan_one_exchange(spark):
    p = plan(spark, "q_ledger_rollup")
    assert p.count("FileScan parquet") == 1 and p.count("Exchange hashpartitioning") == 1 and "Expand" in p


@pytest.mark.parametrize("name", ["q_basic_metrics", "q_metrics_keyed", "q_series_day", "q_anomaly_top8",
                                  "q_anomalies_keyed", "q_forecast", "q_insights", "q_clean_money",
                                  "q_prepared", "q_first_valid_date", "q_role_scores", "q_report_brief"])
def test_no_cartesian_or_nested_loop_join(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_raw_ledger_is_scanned_once(spark):
    """Cleaning decisions are taken after the aggregate: one scan, and only aggregated
    rows are shuffled, also where nothing may be broadcast."""
    from tallyframe.operators.partials import partials, raw_rollup
    from tallyframe.plans import views
    from tallyframe.roles import Roles
    raw = views.raw_orders(spark, SF001)
    roles = Roles(date=["alt_date", "date_text"], amount="money_text", category="o_orderstatus")
    parts = partials(raw, roles, ["o_orderpriority"])
    p = parts._jdf.queryExecution().executedPlan().toString()
    assert p.count("FileScan parquet") == 1 and p.count("Exchange") == 1 and "Join" not in p
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = final_plan(raw_rollup(raw, roles, ["o_orderpriority"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # every shuffle of ledger rows lies above a partial aggregate
    final = p.split("+- == Initial Plan ==")[0]
    for line, above in zip(final.splitlines(), final.splitlines()[1:]):
        if "Exchange hashpartitioning(o_orderpriority" in line:
            assert "Aggregate" in above or "Project" in above or "Filter" in above or "Sort" in above


def test_fleet_reads_each_layout_once_per_pass(spark, tmp_path):
    from tallyframe.plans.analyze import fleet_analysis
    from tallyframe.sources import files
    for name, head, row in (("a", "Date,Kind,Total", "2026-01-0{},x,{}.5"), ("b", "Date,Kind,Total", "2026-02-0{},y,{}.5"),
                            ("c", "Total,Date", "{1}.5,2026-03-0{0}")):
        (tmp_path / f"{name}.csv").write_text(head + "\n" + "".join(row.format(i, i) + "\n" for i in range(1, 8)))
    catalog = files.file_catalog(spark, str(tmp_path))
    assert files.read_ledgers(spark, catalog)._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2
    assert len(fleet_analysis(spark, catalog).basic.collect()) == 3


def test_uncapped_lists_are_ranked(spark):
    """``limit=None`` keeps and numbers everything, in the report too."""
    from tallyframe.operators import report
    from tallyframe.plans import views
    from tallyframe.plans.analyze import analyze
    a = analyze(views.sales(spark, SF001), grain="day", category_limit=None, anomaly_limit=None)
    found = [r["rank"] for r in a.anomalies.orderBy("rank").collect()]
    assert found == list(range(1, len(found) + 1)) and len(found) > 0
    assert [r["rank"] for r in a.categories.orderBy("rank").collect()] == [1, 2, 3]
    sections = {r.section for r in report.build_report(a, "f", "brief", "en").select("section").distinct().collect()}
    assert {"categories", "anomalies"} <= sections


def test_generated_code_fits_a_method(spark):
    """A text date and a text money column into period points: every stage compiles, no
    method beyond the JVM's 64 KB."""
    from tallyframe.operators import series
    from tallyframe.operators.partials import raw_rollup
    from tallyframe.operators.prepare import prepare
    from tallyframe.plans import views
    from tallyframe.roles import Roles
    roles = Roles(date="date_text", amount="money_text")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        raw = views.raw_orders(spark, SF001)
        for df in (series.time_series(prepare(raw, roles)), raw_rollup(raw, roles)):
            stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
            sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
            assert sizes and all(0 < n < 65_536 for n in sizes), sizes
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_profile_shuffles_no_cell_of_number_and_date_columns(spark):
    """Only counts per column are shuffled, and the values of text columns."""
    from tallyframe.operators import detection
    df = spark.range(2000).selectExpr("cast(id as string) as id", "concat('2026-01-', lpad(id % 28 + 1, 2, '0')) as day",
                                      "cast(id / 7 as decimal(12,2)) as price", "concat('kind ', chr(65 + id % 5)) as kind")
    profile = detection.column_profile(detection.long_cells(df))
    got = {r.column: (r.category_unique, r.n_values) for r in profile.collect()}
    assert got == {"id": (None, 2000), "day": (None, 2000), "price": (None, 2000), "kind": (5, 2000)}
    text = profile._jdf.queryExecution().optimizedPlan().toString()
    assert "column#" in text and "IN (kind" in text.replace("= kind", "IN (kind")
    everything = detection.column_profile(detection.long_cells(df), unique="all").collect()
    assert {r.column: r.category_unique for r in everything} == {"id": 2000, "day": 28, "price": 2000, "kind": 5}


def test_uncapped_ranks_use_no_single_partition(spark):
    from pyspark.sql import functions as F

    from tallyframe.operators._keys import top_k
    df = spark.range(5000).selectExpr("id % 3 as shop", "(id * 7919) % 5000 as v", "id").withColumn(
        "shop", F.when(F.col("shop") > 0, F.col("shop")))
    ranked = top_k(df, [], [F.col("v").desc()], None)
    assert [r.rank for r in ranked.orderBy(F.col("v").desc()).collect()] == list(range(1, 5001))
    ranked.collect()
    plan = ranked._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # the one window without keys numbers a row per partition
    assert plan.count("Exchange SinglePartition") <= 1 and "v#" not in plan.split("Window")[1].split("\n")[0]
    keyed = top_k(df, ["shop"], [F.col("v").asc()], None)
    want = {}
    for shop in (None, 1, 2):
        vs = sorted((r.v for r in df.where(F.col("shop").eqNullSafe(F.lit(shop))).collect()))
        want |= {(shop, v): i for i, v in enumerate(vs, 1)}
    assert {(r.shop, r.v): r["rank"] for r in keyed.collect()} == want
    assert top_k(df.limit(0), [], [F.col("v").asc()], None).count() == 0


def test_fleet_joins_no_ledger_row(spark, tmp_path):
    from tallyframe.plans.analyze import fleet_analysis
    from tallyframe.sources import files
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("Date,Region,Total\n" + "\n".join(
            f"2026-01-{d:02d},{'North' if d % 2 else 'South'},{i + d}.50" for d in range(1, 9)) + "\n")
    fleet = fleet_analysis(spark, files.file_catalog(spark, str(tmp_path)))
    plan = fleet.ledger.df._jdf.queryExecution().optimizedPlan().toString()
    read = plan[plan.rindex("Relation"):]
    assert "csv" in read and "Region" in read  # one read of the layout, its columns named by role
    assert fleet.basic.count() == 3


def test_rows_of_a_large_key_are_not_dealt_by_it_for_the_decisions(spark, tmp_path):
    from tallyframe.operators.prepare import prepare
    from tallyframe.roles import Roles

    spark.range(20_000).selectExpr("if(id < 19000, 'a', 'b') AS file", "concat('$', id) AS money", "uuid() AS note") \
        .write.parquet(str(tmp_path / "rows"))
    raw = spark.read.parquet(str(tmp_path / "rows"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10000")  # the rows are larger, the decisions smaller
    try:
        led = prepare(raw, Roles(revenue="money"), ["file"], staged=True).df
        assert "SortMergeJoin" not in led._jdf.queryExecution().executedPlan().toString()
        assert led.selectExpr("sum(revenue)").first()[0] == sum(range(20_000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
