"""Planning and sequential queries read the results no more often than they must."""
import pytest
from pyspark.sql import functions as F

from proofmill.operators import sequential as Q
from workload import load_all, planning, world
from workload.registry import QUERIES

load_all()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Lines of four checks, some without a number, an order or a status, and runs that erred in every check."""
    base = tmp_path_factory.mktemp("plans")
    lines = spark.range(400).selectExpr(
        "IF(id % 37 = 5, NULL, id) AS l_orderkey", "id % 5 AS l_partkey", "id % 2 AS l_suppkey",
        "CASE WHEN id > 390 OR id % 9 = 1 THEN 7 WHEN id % 31 <> 4 THEN int(id % 3) END AS l_linenumber", "double(id % 11) AS l_quantity", "1.0D AS l_extendedprice",
        "double(id % 7) / 10 AS l_discount", "0.0D AS l_tax", "IF(id % 4 < 2, 'A', 'R') AS l_returnflag", "IF(id % 41 = 7, NULL, 'O') AS l_linestatus", "date'2024-01-01' AS l_shipdate")
    lines.write.parquet(f"{base}/lineitem.parquet")
    spark.range(2).selectExpr("id AS s_suppkey", "int(0) AS s_nationkey", "'s' AS s_name", "1.0D AS s_acctbal").write.parquet(f"{base}/supplier.parquet")
    spark.range(1).selectExpr("int(0) AS n_nationkey", "int(0) AS n_regionkey", "'n' AS n_name").write.parquet(f"{base}/nation.parquet")
    return str(base)


def test_results_apart_are_the_ran_results(spark, folder):
    apart, whole = world.ran_apart(spark, folder), world.ran_results(spark, folder)
    assert sorted(map(str, apart.collect())) == sorted(map(str, whole.select(apart.columns).collect()))
    assert 0 < whole.filter("errored").count() < world.timed_results(spark, folder).filter("errored").count()
    plan = Q.outcomes(apart)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and plan.count("Relation [") == 2


def test_sizes_are_the_last_numbers(spark, folder):
    last = world.timed_results(spark, folder).groupBy("batch_id", "entry_id", "label").agg(F.max("batch_index").alias("times"))
    assert sorted(map(str, world.check_sizes(spark, folder).collect())) == sorted(map(str, last.collect()))


@pytest.mark.parametrize("name", ["odds_curves", "batch_plans", "outcome_splits", "likely_undecided_checks", "cheaper_options", "fewest_left_out"])
def test_a_plan_numbers_results_once(spark, folder, monkeypatch, name):
    chances = "passed long, failed long, target double, n int, peak boolean, passes double, fails double, answer double, undecided double"
    monkeypatch.setattr(planning, "_chances", lambda spark, *a, **b: spark.createDataFrame([], chances))
    assert "lineitem" not in " ".join(QUERIES[name](spark, folder).inputFiles())
