"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gleaner.operators.dedup import fold_plan, unique_by_url
from gleaner.operators.skew import ranked
from gleaner.plans.views import Tables

# One-row sides (a scalar, a run's stamp) are subqueries, never joins.
NO_CROSS = sorted(set(entry.queries()) - {n for n in entry.queries() if n.endswith("_stream")})


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_CROSS)
def test_no_cross_or_nested_loop_join(spark, sf_dir, name, monkeypatch):
    """In the plan of the result and in those of all tables that the query writes on its way."""
    plans, frame = [], type(spark.range(0))
    write = frame.write
    monkeypatch.setattr(frame, "write", property(lambda self: (plans.append(physical(self)), write.fget(self))[1]))
    plans.append(physical(entry.queries()[name](spark, sf_dir)))
    assert not [p for p in plans if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]


def test_scoring_stays_in_the_jvm(spark, sf_dir):
    plan = physical(entry.queries()["udf_01_injected_scorer"](spark, sf_dir))
    assert "Python" not in plan and re.search(r"ReadSchema: struct<(doc_id:bigint,)?text:string,source:string>", plan)


def test_narrow_scan_for_short_texts(spark, sf_dir):
    plan = physical(entry.queries()["fil_08_short_text"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_filters_reach_the_scan(spark, sf_dir):
    plan = physical(entry.queries()["stm_02_two_strikes"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)" in plan


def test_first_row_per_key_is_limited_before_the_shuffle(spark, sf_dir):
    plan = physical(unique_by_url(Tables(spark, sf_dir).table("pages").selectExpr("page_id AS seq", "url")))
    assert plan.count("WindowGroupLimit") == 2


def test_ranks_need_no_single_task_over_the_rows(spark, sf_dir):
    plan = physical(entry.queries()["srt_04_probe_candidates"](spark, sf_dir))
    assert plan.count("SinglePartition") == 1  # the chunks' sizes


def test_chunks_of_a_hot_component_are_dealt_out(spark):
    rows = spark.range(90_000).selectExpr("id AS seq", "IF(id % 3 = 0, 0, id) AS component", "'a' AS source", "id AS chars")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = fold_plan(rows, width=1_000)
        assert re.search(r"Exchange hashpartitioning\(component#\d+L?, role#\d+, _chunk#\d+L?", physical(plan))
        some = rows.join(rows.filter("seq < 10").select("component").distinct(), "component")
        sizes = ranked(some, ["component"], F.floor(F.col("seq") / 1_000), [F.col("seq")]).groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == 4 and max(r["count"] for r in sizes) < 0.5 * sum(r["count"] for r in sizes)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
