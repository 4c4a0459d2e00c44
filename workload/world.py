"""The shared tables read as evaluation data, in Spark and in SQL.

lineitem -> results of batches: batch = line status, entry = supplier,
            label = return flag, time = number within the three
supplier -> set entries (set = nation, plan = region)
orders   -> runs of scopes: standalone (O), of a set (F), of a plan (P)
customer -> the tests, sets and plans those runs belong to
documents, conversations, events, embeddings -> texts, pairs, JSON, vectors
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from proofmill.operators.keyed import join_on, number_within, numbered, slice_of
from proofmill.session import kept

from .registry import view


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ── batches of results ───────────────────────────────────────────────────────

def plain_results(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("batch_id"), F.col("l_suppkey").alias("entry_id"),
        F.col("l_returnflag").alias("label"), (F.col("l_quantity") > 5).alias("passed"),
        F.round(F.col("l_discount") * 10, 4).alias("score"),
        (F.col("l_linenumber") == 7).alias("errored"))


def timed_results(spark, sf) -> DataFrame:
    """Every result with its time in the batch."""
    lines = table(spark, sf, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_shipdate"]
    numbered = number_within(lines, ["l_linestatus", "l_suppkey", "l_returnflag"], order,
                             slice_of("l_orderkey", 1 << 16), "batch_index")
    return numbered.select(
        F.col("l_linestatus").alias("batch_id"), F.col("l_suppkey").alias("entry_id"),
        F.col("l_returnflag").alias("label"), F.col("batch_index"),
        F.concat_ws("-", "l_linestatus", "l_suppkey", "batch_index").alias("run_id"),
        (F.col("l_quantity") > 5).alias("passed"),
        F.round(F.col("l_discount") * 10, 4).alias("score"),
        (F.col("l_linenumber") == 7).alias("errored"),
        F.when(F.col("l_linenumber") == 7, F.lit("engine failed")).alias("detail"))


def _marked(spark, sf) -> DataFrame:
    # a run all of whose checks errored had no answer: NotRan
    run = W.partitionBy("batch_id", "entry_id", "batch_index")
    return timed_results(spark, sf).withColumn("not_ran", F.bool_and("errored").over(run))


def told_results(spark, sf) -> DataFrame:
    """The marked rows, numbered once and written, for queries that read both
    the runs and their results. What follows from other columns is not written."""
    told = kept(_marked(spark, sf).drop("run_id", "detail"), "told")
    return told.withColumn("run_id", F.concat_ws("-", "batch_id", "entry_id", "batch_index")).withColumn(
        "detail", F.when(F.col("errored"), F.lit("engine failed")))


def ran_results(spark, sf, told: DataFrame | None = None) -> DataFrame:
    rows = _marked(spark, sf) if told is None else told
    return rows.filter(~F.col("not_ran")).drop("not_ran")


def ran_apart(spark, sf) -> DataFrame:
    """The same rows, for who reads only results without an error: those are
    their own proof that the run ran, and only the others look for one. A
    filter on `errored` leaves the search out of the plan."""
    rows, run = timed_results(spark, sf), ["batch_id", "entry_id", "batch_index"]
    fine, out = rows.filter(~F.col("errored")), rows.filter(~F.col("errored"))
    for kind, value in ((F.col("errored"), True), (F.col("errored").isNull(), None)):
        rest = rows.filter(kind).withColumn("errored", F.lit(value).cast("boolean"))
        out = out.unionByName(join_on(rest, fine.select(*run), run, "left_semi"))
    return out


def check_sizes(spark, sf) -> DataFrame:
    """The last time of each check: its results, as each is numbered. Lines
    without an order come first and have no row themselves."""
    keys = ["l_linestatus", "l_suppkey", "l_returnflag"]
    sizes = table(spark, sf, "lineitem").dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("times"), F.count("l_orderkey").alias("_placed"))
    return sizes.filter("_placed > 0").select(
        F.col("l_linestatus").alias("batch_id"), F.col("l_suppkey").alias("entry_id"), F.col("l_returnflag").alias("label"), "times")


def batch_runs(spark, sf, told: DataFrame | None = None) -> DataFrame:
    ok = F.col("passed") & ~F.col("errored")
    rows = timed_results(spark, sf) if told is None else told
    return (rows.groupBy("batch_id", "entry_id", "batch_index", "run_id")
            .agg(F.bool_and("errored").alias("_none"), F.bool_and(ok).alias("_all"),
                 F.bool_or(ok).alias("_some"))
            .withColumn("status", F.when(F.col("_none"), "NotRan").when(F.col("_all"), "Green")
                        .when(F.col("_some"), "Amber").otherwise("Red"))
            .withColumn("error", F.when(F.col("_none"), F.lit("no answer")))
            .withColumn("asked", F.array(F.lit("A"), F.lit("N"), F.lit("R")))
            .drop("_none", "_all", "_some"))


view("results", """
SELECT l_linestatus AS batch_id, l_suppkey AS entry_id, l_returnflag AS label,
  row_number() OVER (PARTITION BY l_linestatus, l_suppkey, l_returnflag ORDER BY l_orderkey,
    l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS batch_index,
  l_quantity > 5 AS passed, round(l_discount * 10, 4) AS score, l_linenumber = 7 AS errored,
  CASE WHEN l_linenumber = 7 THEN 'engine failed' END AS detail FROM lineitem""")
view("runs_b", """
SELECT batch_id, entry_id, batch_index, batch_id || '-' || entry_id || '-' || batch_index AS run_id,
  CASE WHEN bool_and(errored) THEN 'NotRan' WHEN bool_and(passed AND NOT errored) THEN 'Green'
       WHEN bool_or(passed AND NOT errored) THEN 'Amber' ELSE 'Red' END AS status
FROM results GROUP BY 1, 2, 3""", ["results"])
view("ran", """
SELECT r.*, b.run_id FROM results r JOIN runs_b b USING (batch_id, entry_id, batch_index)
WHERE b.status <> 'NotRan'""", ["results", "runs_b"])
view("folded", """
SELECT a.batch_id, a.entry_id, a.label, coalesce(g.evaluated, 0) AS evaluated, coalesce(g.passed, 0) AS passed,
  coalesce(g.evaluated, 0) - coalesce(g.passed, 0) AS failed, a.ran - coalesce(g.evaluated, 0) AS errored, a.not_ran
FROM (SELECT batch_id, entry_id, label, count(*) FILTER (WHERE status <> 'NotRan') AS ran,
        count(*) FILTER (WHERE status = 'NotRan') AS not_ran
      FROM runs_b, (VALUES ('A'), ('N'), ('R')) t(label) GROUP BY 1, 2, 3) a
LEFT JOIN (SELECT batch_id, entry_id, label, count(*) FILTER (WHERE NOT errored) AS evaluated,
        count(*) FILTER (WHERE NOT errored AND passed) AS passed FROM ran GROUP BY 1, 2, 3) g
USING (batch_id, entry_id, label)""", ["runs_b", "ran"])
view("plain_fold", """
SELECT l_linestatus AS batch_id, l_suppkey AS entry_id, l_returnflag AS label,
  count(*) FILTER (WHERE l_linenumber <> 7) AS evaluated,
  count(*) FILTER (WHERE l_linenumber <> 7 AND l_quantity > 5) AS passed,
  count(*) FILTER (WHERE l_linenumber <> 7 AND NOT l_quantity > 5) AS failed,
  count(*) FILTER (WHERE l_linenumber = 7) AS errored
FROM lineitem GROUP BY 1, 2, 3""")


def binomial_sql(kind: str, k: str, n: str, p: str) -> str:
    """Exact tail as a sum of terms, for the SQL side."""
    low, high = (k, n) if kind == "at_least" else ("0", k)
    return (f"(SELECT coalesce(sum(exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1)"
            f" + i * ln({p}) + ({n} - i) * ln(1 - {p}))), 0)"
            f" FROM generate_series(CAST({low} AS BIGINT), CAST({high} AS BIGINT)) g(i))")


# ── entries and their checks ─────────────────────────────────────────────────

def entries(spark, sf) -> DataFrame:
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    checks = F.expr("""array(
      named_struct('name', 'Exact Match', 'label', 'A', 'config', map_from_arrays(array(), array()), 'answer_path', null),
      named_struct('name', 'ROUGE', 'label', 'N', 'config', map('threshold', '0.45'), 'answer_path', null),
      named_struct('name', 'Correctness', 'label', 'R', 'config', map_from_arrays(array(), array()), 'answer_path', null))""")
    from proofmill.schemas import ASSIGNMENT
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.col("s_suppkey").alias("entry_id"), F.col("s_nationkey").alias("test_set_id"),
        F.col("n_regionkey").alias("plan_id"), F.col("n_name").alias("test_set_name"),
        F.col("s_name").alias("name"), F.col("s_suppkey").alias("test_id"),
        F.concat(F.lit("Ask "), "s_name").alias("input"),
        F.when(F.col("s_acctbal") > 0, F.concat(F.lit("Expect "), "s_name")).alias("expected_output"),
        F.when(F.col("s_acctbal") > 3000, F.concat(F.lit("Say "), "s_name")).alias("model_output"),
        checks.cast(f"array<{ASSIGNMENT}>").alias("assignments"))


view("entries", """
SELECT s_suppkey AS entry_id, s_nationkey AS test_set_id, n_regionkey AS plan_id, n_name AS test_set_name,
  s_name AS name, s_suppkey AS test_id, 'Ask ' || s_name AS input,
  CASE WHEN s_acctbal > 0 THEN 'Expect ' || s_name END AS expected_output,
  CASE WHEN s_acctbal > 3000 THEN 'Say ' || s_name END AS model_output
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
view("labels3", "SELECT * FROM (VALUES ('A', 'Exact Match'), ('N', 'ROUGE'), ('R', 'Correctness')) t(label, test_type)")


# ── runs of scopes ───────────────────────────────────────────────────────────

STATUS_OF = {"1-URGENT": "Red", "2-HIGH": "Amber", "3-MEDIUM": "Green", "4-NOT SPECIFIED": "NotRan",
             "5-LOW": "Pending"}


def scope_runs(spark, sf) -> DataFrame:
    """Runs with exactly one owner: a test (O), a set (F) or a plan (P)."""
    o = table(spark, sf, "orders")
    status = F.coalesce(*[F.when(F.col("o_orderpriority") == k, F.lit(v)) for k, v in STATUS_OF.items()])
    year = F.year("o_orderdate")
    owner = lambda letter: F.when(F.col("o_orderstatus") == letter, F.col("o_custkey"))
    return o.select(
        F.col("o_orderkey").alias("run_id"), status.alias("status"),
        owner("O").alias("test_id"), owner("F").alias("set_id"), owner("P").alias("plan_id"),
        F.col("o_custkey").alias("scope_id"),
        F.when(F.col("o_orderstatus") != "O",
               F.concat_ws("-", "o_orderstatus", "o_custkey", year)).alias("execution_id"),
        F.when(F.col("o_totalprice") > 350000, F.concat_ws("-", F.lit("B"), "o_custkey", year)).alias("batch_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_totalprice").alias("weight"))


view("sruns", """
SELECT o_orderkey AS run_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Red' WHEN '2-HIGH' THEN 'Amber' WHEN '3-MEDIUM' THEN 'Green'
    WHEN '4-NOT SPECIFIED' THEN 'NotRan' WHEN '5-LOW' THEN 'Pending' END AS status,
  CASE WHEN o_orderstatus = 'O' THEN o_custkey END AS test_id,
  CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS set_id,
  CASE WHEN o_orderstatus = 'P' THEN o_custkey END AS plan_id, o_custkey AS scope_id,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus || '-' || o_custkey || '-' || year(o_orderdate) END AS execution_id,
  CASE WHEN o_totalprice > 350000 THEN 'B-' || o_custkey || '-' || year(o_orderdate) END AS batch_id,
  o_orderdate AS created_at, o_totalprice AS weight FROM orders""")


def executions(spark, sf) -> DataFrame:
    runs = scope_runs(spark, sf).filter("execution_id is not null")
    return runs.groupBy("execution_id", "scope_id").agg(
        F.when(F.max("set_id").isNotNull(), "test_set").otherwise("test_plan").alias("origin"),
        F.min("created_at").alias("created_at"), F.min("batch_id").alias("batch_id"))


view("execs", """
SELECT execution_id, scope_id, CASE WHEN max(set_id) IS NOT NULL THEN 'test_set' ELSE 'test_plan' END AS origin,
  min(created_at) AS created_at, min(batch_id) AS batch_id FROM sruns WHERE execution_id IS NOT NULL GROUP BY 1, 2""",
     ["sruns"])


def scopes(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                    F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"),
                    F.col("c_acctbal").alias("balance"))


view("scopes", """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation,
  c_acctbal AS balance FROM customer""")


def scope_batches(spark, sf) -> DataFrame:
    """Batches of scopes: one per (scope, year) that had a dear run."""
    runs = scope_runs(spark, sf).filter("batch_id is not null")
    return runs.groupBy("batch_id", "scope_id").agg(
        F.min("created_at").alias("created_at"), F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("status") == "Green").alias("greens"),
        F.count_if(F.col("status").isin("Pending", "Running")).alias("open")).withColumn(
        "status", F.when(F.col("open") > 0, "Running").when(F.col("greens") == F.col("runs"), "Passed")
        .when(F.col("greens") == 0, "Failed").otherwise("Inconclusive")).drop("greens")


view("sbatches", """
SELECT batch_id, scope_id, min(created_at) AS created_at, count(*) AS runs,
  count(*) FILTER (WHERE status IN ('Pending', 'Running')) AS open,
  CASE WHEN count(*) FILTER (WHERE status IN ('Pending', 'Running')) > 0 THEN 'Running'
       WHEN count(*) FILTER (WHERE status = 'Green') = count(*) THEN 'Passed'
       WHEN count(*) FILTER (WHERE status = 'Green') = 0 THEN 'Failed' ELSE 'Inconclusive' END AS status
FROM sruns WHERE batch_id IS NOT NULL GROUP BY 1, 2""", ["sruns"])


# ── texts ────────────────────────────────────────────────────────────────────

def following(ids: DataFrame, key: str) -> DataFrame:
    """(key, _after): the next existing id of each id, null for the last."""
    places = numbered(ids.select(key), [F.col(key)], "_n")
    return places.join(places.select((F.col("_n") - 1).alias("_n"), F.col(key).alias("_after")), "_n", "left").drop("_n")


def text_pairs(spark, sf) -> DataFrame:
    """Whole documents, each against the next document by id; the last has none."""
    d = table(spark, sf, "documents")
    after = d.select(F.col("doc_id").alias("_after"), F.col("text").alias("reference"))
    return d.join(following(d, "doc_id"), "doc_id").join(after, "_after", "left").select(
        F.col("doc_id").alias("run_id"), F.lit("text").alias("label"), F.col("text").alias("answer"), "reference")


view("pairs", """SELECT a.doc_id AS run_id, 'text' AS label, a.text AS answer, b.text AS reference
FROM documents a LEFT JOIN (SELECT doc_id, lead(doc_id) OVER (ORDER BY doc_id) AS after FROM documents) n USING (doc_id)
LEFT JOIN documents b ON b.doc_id = n.after""")


def turn_pairs(spark, sf) -> DataFrame:
    """User turn, the assistant's reply, and the reply after as the expected one."""
    t = table(spark, sf, "conversations")
    user = t.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("input"))
    said = t.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("model_output"))
    later = t.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 3).alias("turn"), F.col("text").alias("expected_output"))
    return user.join(said, ["conv_id", "turn"], "left").join(later, ["conv_id", "turn"], "left")


view("turns", """
SELECT u.conv_id, u.turn, u.text AS input, a.text AS model_output, e.text AS expected_output
FROM conversations u
LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
LEFT JOIN conversations e ON e.conv_id = u.conv_id AND e.turn = u.turn + 3 AND e.role = 'assistant'
WHERE u.role = 'user'""")


def dataset_rows(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("dataset_id"),
                    (F.col("doc_id") + 1).cast("int").alias("position"), F.col("text").alias("input"),
                    F.col("lang").alias("expected_output"),
                    F.when(F.col("n_chars") > 500, F.col("text")).alias("model_output"))


view("drows", """SELECT doc_id AS id, source AS dataset_id, CAST(doc_id + 1 AS INTEGER) AS position, text AS input,
  lang AS expected_output, CASE WHEN n_chars > 500 THEN text END AS model_output FROM documents""")
