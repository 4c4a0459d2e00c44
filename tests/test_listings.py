"""The package's listings: every filter against plain Python, and only the joins that are read."""
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from proofmill.operators import listings

DAY = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def run_rows(spark):
    rows = [(i, ("Green", "Red", "Pending")[i % 3], DAY + timedelta(days=i), i % 4 if i % 2 else None, None if i % 2 else i, None if i % 2 else i % 5,
             i % 3 if i % 6 == 0 else None, f"b{i % 4}" if i % 5 == 0 else None, ["BLEU"] if i % 2 else ["BLEU", "Bias"]) for i in range(60)]
    return spark.createDataFrame(rows, "run_id long, status string, created_at timestamp, test_id long, entry_id long, set_id long, plan_id long, batch_id string, types array<string>")


def run_list(spark, run_rows):
    named = lambda kind, n: spark.createDataFrame([(i, f"{kind} {i}") for i in range(n)], f"{kind}_id long, name string")
    tests = named("test", 4).withColumn("dataset_id", F.when(F.col("test_id") > 1, F.lit(7)).cast("long"))
    batches = spark.createDataFrame([(f"b{i}", s) for i, s in enumerate(("Passed", "Failed", "Running", "Passed"))], "batch_id string, status string")
    datasets = spark.createDataFrame([(7, "seven")], "dataset_id long, name string")
    return listings.run_listing(run_rows, tests, named("entry", 60), named("set", 5), named("plan", 3), batches, datasets, {"feb": datetime(2024, 2, 1)})


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_are_named_and_filtered(spark, run_rows):
    listing = run_list(spark, run_rows)
    rows = {r.run_id: r for r in run_rows.collect()}
    got = listing.where({"status": ["Red"], "search": ["TEST"], "dataset": ["seven"]}).collect()
    assert {r.run_id for r in got} == {i for i, r in rows.items() if r.status == "Red" and r.test_id in (2, 3)}
    assert all(r["name"] == f"test {r.test_id}" for r in got)
    got = listing.where({"verdict": ["Passed"], "type": ["Bias"]}).collect()
    assert {r.run_id for r in got} == {i for i, r in rows.items() if r.batch_id in ("b0", "b3") and "Bias" in r.types}
    page = listing.page({"origin": ["test_set"]}, "name", 2, 5).collect()
    want = sorted((f"entry {r.entry_id}", i) for i, r in rows.items() if r.test_id is None and r.set_id is not None)[2:7]
    assert [(r["name"], r.run_id) for r in page] == want


def test_only_the_joins_that_are_read(spark, run_rows):
    listing = run_list(spark, run_rows)
    assert "Join" not in plan_of(listing.count({"status": ["Red"], "batch": ["none"]}))
    assert plan_of(listing.count({"verdict": ["Passed"]})).count("Join ") + plan_of(listing.count({"verdict": ["Passed"]})).count("Join [") >= 1
    assert "Join" not in plan_of(listing.facets({"status": ["Red"]}))
    shown = plan_of(listing.page({}, "newest"))
    assert shown.count("LeftOuter") == 4 and plan_of(listing.page({"dataset": ["none"]}, "newest")).count("LeftOuter") == 5


def test_facets_leave_out_their_own_filter(spark, run_rows):
    rows = run_rows.collect()
    got = {(r.facet, r.value): r["count"] for r in run_list(spark, run_rows).facets({"status": ["Red"], "search": ["entry"]}).collect()}
    entry = [r for r in rows if r.test_id is None]
    assert got["status", "Green"] == sum(r.status == "Green" for r in entry) and got["status", "Amber"] == 0
    assert got["created", "feb"] == sum(r.status == "Red" and r.created_at >= datetime(2024, 2, 1) for r in entry)


def test_tests_by_every_filter(spark):
    kind = "array<struct<name:string,label:string>>"
    rows = [(1, "One", "what is up", None, 7, 2, DAY, [("BLEU", "near")]), (2, "Two", "x", "y", None, None, DAY + timedelta(days=1), [("Bias", "fair"), ("BLEU", "b")]), (3, "Three", "z", "y", 7, 1, DAY, [])]
    tests = spark.createDataFrame(rows, f"test_id long, name string, input string, model_output string, dataset_id long, row_position int, created_at timestamp, assignments {kind}")
    standing = spark.createDataFrame([(1, "Red", DAY + timedelta(days=5), None, None, 2), (2, None, None, "Passed", DAY + timedelta(days=9), 0)],
                                     "id long, last_status string, run_at timestamp, last_verdict string, batch_at timestamp, sets long")
    listing = listings.test_listing(tests, standing, spark.createDataFrame([(7, "seven")], "dataset_id long, name string"))
    ids = lambda **chosen: sorted(r.test_id for r in listing.where(chosen).collect())
    assert ids(type=["Bias"]) == [2] and ids(type=["none"]) == [3] and ids(answer=["recorded"]) == [2, 3] and ids(in_set=["yes"]) == [1]
    assert ids(dataset=[7]) == [1, 3] and ids(dataset=["none"]) == [2] and ids(created=[DAY + timedelta(hours=1), None]) == [2]
    assert ids(search=["FAIR"]) == [2] and ids(search=["is up", "near"]) == [1] and ids(run=["never"]) == [2, 3] and ids(verdict=["Passed"]) == [2]
    order = lambda sort: [r.test_id for r in listing.page({}, sort).collect()]
    assert order("activity") == [2, 1, 3] and order("created") == [2, 1, 3] and order("dataset_row") == [3, 1, 2] and order("name") == [1, 3, 2]
    assert "Join" not in plan_of(listing.count({"type": ["Bias"], "answer": ["asked"]}))


def test_scopes_and_links(spark):
    scopes = spark.createDataFrame([(1, "A", DAY, [9], [4], None), (2, "B", DAY, [], [4, 5], None)], "id long, name string, created_at timestamp, plans array<long>, tests array<long>, sets array<long>")
    standing = spark.createDataFrame([(1, None, "Red", DAY)], "id long, last_verdict string, last_outcome string, last_at timestamp")
    listing = listings.scope_listing(scopes, standing)
    ids = lambda **chosen: sorted(r.id for r in listing.where(chosen).collect())
    assert ids(in_plan=["any"]) == [1] and ids(in_plan=["none"]) == [2] and ids(holds_test=[5]) == [2] and ids(outcome=["never"]) == [2] and ids(holds_set=["none"]) == [1, 2]
    assert [r.id for r in listing.page({}, "latest").collect()] == [1, 2]
    links = spark.createDataFrame([(1, 9), (1, 9), (1, 8), (2, 9)], "test_set_id long, plan_id long")
    plans = spark.createDataFrame([(8, "eight"), (9, "nine")], "plan_id long, name string")
    assert sorted(map(tuple, listings.plans_linking(links, plans).collect())) == [(1, 8, "eight"), (1, 9, "nine"), (2, 9, "nine")]
