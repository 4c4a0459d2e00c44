"""Streams that call Python get many keys a call, and mix no two of them."""
from pyspark.sql import functions as F

from proofmill.operators import sequential as Q
from proofmill.streaming import runs as R


def _most_states(query):
    return max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])


def test_open_runs_share_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "BUCKETS", 3)
    at = "timestamp('2024-01-01 00:00:00')"
    runs = spark.range(500).selectExpr("id AS run_id", f"{at} + make_interval(0, 0, 0, 0, 0, int(id % 60)) AS ts", "'Pending' AS status")
    moved = runs.filter("run_id % 5 = 0").withColumns({"status": F.lit("Green"), "ts": F.col("ts") + F.expr("interval 1 minute")})
    later = spark.range(1).selectExpr("id + 1000 AS run_id", f"{at} + interval 1 day AS ts", "'Green' AS status")
    for part in (runs.limit(300).unionByName(moved), runs, later):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    folder, query = R.to_table(R.stream_stale_pending(stream), "append", "stale")
    rows = spark.read.schema("run_id long, pending_since timestamp").parquet(folder).collect()
    assert sorted(r.run_id for r in rows) == [i for i in range(500) if i % 5]
    assert all(r.pending_since.minute == r.run_id % 60 for r in rows)
    assert 0 < _most_states(query) <= 3


def test_open_checks_share_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "BUCKETS", 3)
    n = spark.range(60 * 40).selectExpr("'b' AS batch_id", "id % 60 AS entry_id", "IF(id % 60 = 7, NULL, 'x') AS label", "int(id / 60) + 1 AS batch_index",
                                        "IF(id % 11 = 3, NULL, id % 60 < 30 OR (id / 60) % 2 < 1) AS passed", "id % 13 = 5 AS errored", "double(id % 7) / 7 AS score")
    for _ in range(2):
        n.repartition(3, "batch_index").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(n.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    plans = spark.createDataFrame([("b", [10, 25, 40], 0.95, 0.8)], "batch_id string, looks array<int>, level double, target double")
    folder, query = R.to_table(R.stream_sequential(stream, plans), "append", "t")
    got = spark.read.schema(R.DECISIONS).parquet(folder)
    want = Q.decide(Q.outcomes(n), plans)
    names = ["entry_id", "label", "verdict", "at_time", "passes", "evaluated"]
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, want.select(*names).collect()))
    assert got.count() == 60 and 0 < _most_states(query) <= 3
    plans = plans.selectExpr("batch_id", "looks", "level", "0.45D AS threshold", "true AS higher_passes")
    folder, query = R.to_table(R.stream_sequential_means(stream, plans), "append", "m")
    got, want = spark.read.schema(R.MEAN_DECISIONS).parquet(folder), Q.decide_mean(Q.scores(n), plans)
    means = [*names[:4], "n", F.round("mean", 6).alias("mean")]
    assert sorted(map(str, got.select(*means).collect())) == sorted(map(str, want.select(*means).collect()))
    assert 0 < _most_states(query) <= 3


def test_an_open_result_costs_a_few_bytes_of_state(spark, tmp_path):
    n = spark.range(300_000).selectExpr("'b' AS batch_id", "id % 3 AS entry_id", "'x' AS label", "int(id / 3) + 2 AS batch_index", "double(id % 977) / 977 AS score", "false AS errored")
    n.repartition(2, "batch_index").write.parquet(str(tmp_path / "in"))  # no wave is complete, as the first time lacks
    stream = spark.readStream.schema(n.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    plans = spark.sql("SELECT 'b' AS batch_id, array(100001) AS looks, 0.95D AS level, 0.5D AS threshold, true AS higher_passes")
    folder, query = R.to_table(R.stream_sequential_means(stream, plans), "append", "m")
    assert not any(p["stateOperators"][0]["numRowsUpdated"] == 0 for p in query.recentProgress if p["numInputRows"])
    assert spark.read.schema(R.MEAN_DECISIONS).parquet(folder).count() == 0
    assert max(p["stateOperators"][0]["customMetrics"]["stateOnCurrentVersionSizeBytes"] for p in query.recentProgress if p["stateOperators"]) < 16 * 300_000


def test_a_t_tail_serves_both_directions():
    for t, df in ((0.0, 3), (1.7, 9), (-2.5, 40), (60.0, 5)):
        above, below = R._t_tails(t, df)
        assert above + below == 1 and R._t_tails(-t, df) == (below, above)
