import pytest
"""Ingest, authoring, listings, skewed keys and streams on small inputs."""
import random
from datetime import datetime

from pyspark.sql import functions as F

from proofmill.operators import authoring as A
from proofmill.operators import keyed, listing as L, standing as S
from proofmill.operators.rollup import roll_up_runs
from proofmill.sources import lines
from proofmill.streaming import runs as R


def test_lines_are_numbered_across_splits(spark, tmp_path):
    body = [f'{{"prompt": "p{i}", "expected_output": "e", "model_output": ""}}' if i % 7 else "" for i in range(5000)]
    (tmp_path / "a.jsonl").write_bytes(("﻿" + "\r\n".join(body)).encode())
    (tmp_path / "b.jsonl").write_bytes("{}\r[1]\n\nbad".encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = lines.read_eval_jsonl(spark, str(tmp_path))
        good, bad = lines.validate_rows(got)
        a = {r["line"]: r["input"] for r in good.collect()}
        assert a == {i + 1: f"p{i}" for i in range(5000) if i % 7}
        assert {r["line"]: len(r["problems"]) for r in bad.collect()} == {1: 3, 2: 1, 4: 1}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_numbering_with_one_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 5)}", i) for i in rng.sample(range(10_000), 3000)]
    df = spark.createDataFrame(rows, "k string, i long")
    got = keyed.number_within(df, ["k"], ["i"], keyed.slice_of("i", 64), "n").collect()
    seen = {}
    for k, i in sorted(rows):
        seen[k] = seen.get(k, 0) + 1
        rows_n = seen[k]
        assert next(r["n"] for r in got if r["k"] == k and r["i"] == i) == rows_n if i % 50 == 0 else True
    assert len(got) == len(rows) and {r["n"] for r in got if r["k"] == "hot"} == set(range(1, seen["hot"] + 1))


def test_default_labels_skip_taken_ones(spark):
    rows = [(1, 1, "X", None), (1, 2, "X", "x 2"), (1, 3, "X", None), (1, 4, "X", None), (1, 5, "Y", "x"), (2, 1, "X", None), (2, 2, "X", "X 4"), (2, 3, "X", "")]
    df = spark.createDataFrame(rows, "test_id int, pos int, name string, label string")
    got = {(r["test_id"], r["pos"]): r["label"] for r in A.label_assignments(df).collect()}
    assert got == {(1, 1): "X 3", (1, 2): "x 2", (1, 3): "X 4", (1, 4): "X 5", (1, 5): "x", (2, 1): "X", (2, 2): "X 4", (2, 3): "X 2"}


def test_value_problems(spark):
    df = spark.createDataFrame([("regex", "("), ("regex", "a+"), ("json", "{"), ("json", "1"), ("jsonpath", "$..a"), ("jsonpath", "a.b[0]"),
                                ("json_schema", "[1]"), ("json_schema", "{}"), ("json_schema", "x")], "kind string, value string")
    got = {(r["kind"], r["value"]): r["problem"] for r in A.validate_values(df).collect()}
    assert {k for k, v in got.items() if v} == {("regex", "("), ("json", "{"), ("jsonpath", "$..a"), ("json_schema", "[1]"), ("json_schema", "x")}


def world(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["Red", "Green", None]), rng.choice("ab"), rng.sample(["p", "q", "r"], rng.randint(0, 3)), datetime(2024, 1, 1 + i % 20)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, status string, kind string, tags array<string>, created_at timestamp")
    return L.Listing(df, "id", filters={"status": L.among_or_absent("status", "never"), "kind": L.among("kind"), "tags": L.holds_any("tags"), "created": L.created()},
                     facets_of={"status": L.Facet("status", absent="never", fixed=("Amber",)), "kind": L.Facet("kind"), "tags": L.Facet("tags", array=True)},
                     sorts={"new": [F.desc("created_at")]})


def test_every_facet_count_is_the_lists_total_for_that_value(spark):
    listing = world(spark)
    for chosen in ({}, {"status": ["Red"]}, {"kind": ["a"], "tags": ["p", "q"]}, {"status": ["never"], "created": [datetime(2024, 1, 5), None]}):
        counts = {(r["facet"], r["value"]): r["count"] for r in listing.facets(chosen).collect()}
        assert counts[("status", "Amber")] == 0
        for (facet, value), count in counts.items():
            assert listing.count({**chosen, facet: [value]}).first()["total"] == count


def test_pages_are_stable_and_bounded(spark):
    listing = world(spark)
    first = [r["id"] for r in listing.page({}, "new", 0, 30).collect()]
    second = [r["id"] for r in listing.page({}, "new", 30, 30).collect()]
    assert len(set(first) | set(second)) == 60


def test_a_run_left_with_no_check_is_green(spark):
    results = spark.createDataFrame([(1, True, False), (1, False, True)], "run_id int, passed boolean, errored boolean")
    runs = spark.createDataFrame([(1,), (2,)], "run_id int")
    assert {r["run_id"]: r["status"] for r in roll_up_runs(results, runs).collect()} == {1: "Amber", 2: "Green"}


def test_execution_outcome_takes_the_worst(spark):
    df = spark.createDataFrame([(1, "Green"), (1, "Pending"), (2, "Red"), (2, "NotRan"), (3, "Amber"), (3, "Green")], "execution_id int, status string")
    assert {r["execution_id"]: r["outcome"] for r in S.execution_outcome(df).collect()} == {1: "Running", 2: "NotRan", 3: "Amber"}


def test_a_streamed_decision_is_made_once_and_late_results_change_nothing(spark, tmp_path):
    schema = "batch_id string, entry_id long, label string, batch_index int, passed boolean, errored boolean"
    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    put("1", [("b", 1, "x", i, True, False) for i in range(1, 31)] + [("b", 2, "x", i, i % 2 == 0, False) for i in range(1, 31)])
    put("2", [("b", 1, "x", i, False, False) for i in range(31, 61)] + [("b", 3, "x", i, True, False) for i in range(1, 20)])
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    put("3", [("b", 1, "x", i, False, False) for i in range(1, 61)] + [(x, 9, "x", 1, True, False) for x in ("none", "empty", "sure", "twice", "back")])
    plans = spark.createDataFrame([("b", [30, 60], 0.95, 0.9), ("none", None, 0.95, 0.9), ("empty", [], 0.95, 0.9), ("sure", [1], 0.95, 1.0), ("back", [5, 2], 0.95, 0.9),
                                   ("twice", [1], 0.95, 0.9), ("twice", [2], 0.95, 0.9)], "batch_id string, looks array<int>, level double, target double")
    folder, _ = R.to_table(R.stream_sequential(stream, plans), "append", "t")
    rows = spark.read.schema(R.DECISIONS).parquet(folder).collect()
    got = {r["entry_id"]: (r["verdict"], r["at_time"], r["passes"]) for r in rows if r["batch_id"] == "b"}
    assert got == {1: ("pass", 30, 30), 2: ("fail", 30, 15)}
    assert sorted((r["batch_id"], r["error"], r["verdict"]) for r in rows if r["batch_id"] != "b") == [
        ("back", "looks_not_rising", None), ("empty", "no_looks", None), ("none", "no_looks", None), ("sure", "target_out_of_range", None), ("twice", "several_plans", None)]


def test_streamed_tails_are_exact():
    from math import comb
    for n in (1, 5, 40):
        for k in range(n + 1):
            for p in (0.05, 0.5, 0.9):
                terms = [comb(n, i) * p**i * (1 - p)**(n - i) for i in range(n + 1)]
                assert R._tail(k, n, p, True) == pytest.approx(sum(terms[k:]), rel=1e-9, abs=1e-14)
                assert R._tail(k, n, p, False) == pytest.approx(sum(terms[:k + 1]), rel=1e-9, abs=1e-14)
    for t, df, want in ((0.0, 5, 0.5), (1.0, 1, 0.25), (2.0, 10, 0.036694), (-2.0, 10, 0.963306), (1.96, 100000, 0.024998), (12.0, 3, 0.000622)):
        assert R._t_above(t, df) == pytest.approx(want, abs=2e-6)


def test_streamed_means(spark, tmp_path):
    schema = "batch_id string, entry_id long, label string, batch_index int, score double, errored boolean"
    rows = [("b", 1, "x", i, 0.9 + i % 3 / 100, False) for i in range(1, 21)] + [("b", 2, "x", i, 0.4, i % 2 == 0) for i in range(1, 11)]
    rows += [("b", 3, "x", i, 0.49 + i % 2 / 50, False) for i in range(1, 21)]
    for name in ("1", "2"):  # replayed as a whole
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in" / name))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    plans = spark.createDataFrame([("b", [10, 20], 0.975, 0.5, True)], "batch_id string, looks array<int>, level double, threshold double, higher_passes boolean")
    folder, _ = R.to_table(R.stream_sequential_means(stream, plans), "append", "m")
    got = {r.entry_id: (r.verdict, r.at_time, r.n, round(r["mean"], 6)) for r in spark.read.schema(R.MEAN_DECISIONS).parquet(folder).collect()}
    assert got == {1: ("pass", 10, 10, 0.91), 2: ("fail", 10, 5, 0.4), 3: (None, None, 20, 0.5)}


@pytest.mark.parametrize("name", ["execution_checks", "batch_status_roll_up", "fold_check_results", "check_series"])
def test_results_are_numbered_once_a_query(spark, monkeypatch, name):
    from workload import world
    calls, own = [], world.timed_results
    monkeypatch.setattr(world, "timed_results", lambda *a: calls.append(a) or own(*a))
    __import__("__spark_entry__").queries()[name](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_values_are_made_distinct_once(spark):
    from proofmill.operators import authoring
    values = spark.createDataFrame([("json", "{"), ("regex", "("), ("json", "{")], "kind string, value string")
    found = authoring.validate_values(values)
    assert "Exchange" not in found._jdf.queryExecution().toString() and found.count() == 2
