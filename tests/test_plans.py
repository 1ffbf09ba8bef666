"""Plan assertions: one scan of the analysis table where one pass
suffices, partition pruning for week slices, the product dimension broadcast by
AQE, no Python in the column operators."""
import datetime as dt
import re

import __spark_entry__ as E
from revspark.operators import anomalies as H
from revspark.session import scratch_path

SF = "/root/testdata/sf0.001"


def executed_plan(df) -> str:
    """The final adaptive plan of an execution of this very DataFrame."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=false" not in plan
    return plan.split("== Initial Plan ==")[0]


def test_brand_scores_scan_analysis_once(spark):
    plan = executed_plan(E.queries()["brand_scores_all"](spark, SF))
    assert len(re.findall(r"review_analysis", plan)) == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_topic_total_vs_negative_single_pass(spark):
    plan = executed_plan(E.queries()["topic_total_vs_negative"](spark, SF))
    assert len(re.findall(r"review_analysis", plan)) == 1
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_week_slice_prunes_partitions(spark):
    path = scratch_path(spark, "t-days")
    days = [dt.date(2001, 7, 1) + dt.timedelta(days=i) for i in range(30)]
    spark.createDataFrame([(i, d, 0) for i, d in enumerate(days)], "review_id long, review_date date, sentiment int") \
        .write.partitionBy("review_date").parquet(path)
    week = H.in_week_of(spark.read.parquet(path), "2001-07-18")
    plan = executed_plan(week)
    assert "PartitionFilters: [isnotnull(review_date" in plan
    assert week.count() == 7


def test_product_dimension_broadcast(spark):
    for q in ("category_sales", "day_anomaly_reviews"):
        plan = executed_plan(E.queries()[q](spark, SF))
        assert "BroadcastHashJoin" in plan, q


def test_filters_reach_the_scan(spark):
    plan = executed_plan(E.queries()["daily_reviews_dates"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(review_date", plan)


def test_product_scores_scan_analysis_once(spark):
    plan = executed_plan(E.queries()["product_score"](spark, SF))
    assert len(re.findall(r"review_analysis", plan)) == 1


def test_reports_without_sizes_read_no_reviews(spark):
    for q in ("anomaly_by_product", "product_report_lines"):
        plan = executed_plan(E.queries()[q](spark, SF))
        assert not re.findall(r"/reviews\b", plan) and len(re.findall(r"review_analysis", plan)) == 1, q
