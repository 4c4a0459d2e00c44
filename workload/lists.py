"""Listings, facets, standing and executions over orders read as runs."""
from __future__ import annotations

from pyspark.sql import functions as F

from proofmill.operators import keyed
from proofmill.operators import listing as L
from proofmill.operators import listings
from proofmill.operators import standing as S

from . import world
from .registry import query, view

STATUSES = ("Pending", "Running", "Green", "Amber", "Red", "NotRan")


def _runs(spark, sf):
    """Runs with the name of their scope and the check types they ask."""
    runs = world.scope_runs(spark, sf)
    names = world.scopes(spark, sf).select(F.col("id").alias("scope_id"), "name", "segment")
    return (runs.join(names, "scope_id", "left").withColumn("origin", L.origin())
            .withColumn("types", F.array_compact(F.array(F.lit("Exact Match"), F.when(F.col("weight") > 200000, "BLEU"),
                                                         F.when(F.col("weight") > 400000, "Bias")))))


view("lruns", """SELECT r.*, c.name, c.segment, CASE WHEN test_id IS NOT NULL THEN 'standalone' WHEN set_id IS NOT NULL THEN 'test_set' ELSE 'test_plan' END AS origin
FROM sruns r LEFT JOIN scopes c ON c.id = r.scope_id""", ["sruns", "scopes"])


def run_list(spark, sf) -> L.Listing:
    return L.Listing(
        _runs(spark, sf), "run_id",
        filters={"status": L.among("status"), "origin": L.among("origin"), "batch": L.batch_filter(), "set": L.among("set_id"),
                 "plan": L.among("plan_id"), "type": L.holds_any("types"), "created": L.created(), "search": L.search("name", "segment"),
                 "segment": L.among("segment")},
        facets_of={"status": L.Facet("status", fixed=STATUSES), "origin": L.Facet("origin", fixed=("standalone", "test_set", "test_plan")),
                   "segment": L.Facet("segment"), "type": L.Facet("types", array=True),
                   "batch": L.Facet(buckets={"none": F.col("batch_id").isNull(), "any": F.col("batch_id").isNotNull()}),
                   "created": L.Facet(buckets=L.created_buckets("created_at", {
                       "y1999": _ts("1999-01-01"), "y2000": _ts("2000-01-01")}))},
        sorts={"newest": [F.desc("created_at")], "name": [F.lower("name")], "worst": [S.status_rank(), F.lower("name")]})


def _ts(text):
    from datetime import datetime
    return datetime.fromisoformat(text)


CHOSEN = {"status": ["Red", "Amber"], "segment": ["BUILDING", "MACHINERY"], "created": [_ts("1996-01-01"), _ts("2001-01-01")]}
_W = {"status": "status IN ('Red', 'Amber')", "segment": "segment IN ('BUILDING', 'MACHINERY')",
      "created": "created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '2001-01-01'"}


def _others(name):
    return " AND ".join(v for k, v in _W.items() if k != name) or "true"


@query("listed_runs", f"SELECT run_id, status, origin, name FROM lruns WHERE {_others('')}", ["lruns"])
def listed_runs(spark, sf):
    return run_list(spark, sf).where(CHOSEN).select("run_id", "status", "origin", "name")


@query("run_list_page", f"SELECT run_id, name, strftime(created_at, '%Y-%m-%d') AS day FROM lruns WHERE {_others('')} ORDER BY created_at DESC, run_id LIMIT 100 OFFSET 50", ["lruns"])
def run_list_page(spark, sf):
    return run_list(spark, sf).page(CHOSEN, "newest", 50, 100).select("run_id", "name", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("run_list_count", f"SELECT count(DISTINCT run_id) AS total FROM lruns WHERE {_others('')}", ["lruns"])
def run_list_count(spark, sf):
    return run_list(spark, sf).count(CHOSEN)


@query("run_facets", f"""
WITH f AS (SELECT 'status' AS facet, status AS value, count(*) AS n FROM lruns WHERE {_others('status')} GROUP BY 2
UNION ALL SELECT 'origin', origin, count(*) FROM lruns WHERE {_others('')} GROUP BY 2
UNION ALL SELECT 'segment', segment, count(*) FROM lruns WHERE {_others('segment')} GROUP BY 2
UNION ALL SELECT 'type', t, count(*) FROM lruns, (VALUES ('Exact Match', -1.0), ('BLEU', 200000.0), ('Bias', 400000.0)) v(t, least) WHERE weight > least AND {_others('')} GROUP BY 2
UNION ALL SELECT 'batch', CASE WHEN batch_id IS NULL THEN 'none' ELSE 'any' END, count(*) FROM lruns WHERE {_others('')} GROUP BY 2
UNION ALL SELECT 'created', 'y1999', count(*) FROM lruns WHERE created_at >= TIMESTAMP '1999-01-01' AND {_others('created')}
UNION ALL SELECT 'created', 'y2000', count(*) FROM lruns WHERE created_at >= TIMESTAMP '2000-01-01' AND {_others('created')}
UNION ALL SELECT 'created', 'before', count(*) FROM lruns WHERE created_at < TIMESTAMP '1999-01-01' AND {_others('created')}
UNION ALL SELECT 'status', s, 0 FROM (VALUES {', '.join(f"('{s}')" for s in STATUSES)}) v(s))
SELECT facet, value, CAST(sum(n) AS BIGINT) AS count FROM f GROUP BY 1, 2""", ["lruns"])
def run_facets(spark, sf):
    return run_list(spark, sf).facets(CHOSEN)


@query("searched_runs", "SELECT run_id FROM lruns WHERE contains(lower(name || ' ' || segment), 'mach') AND contains(lower(name), '#0000001')", ["lruns"])
def searched_runs(spark, sf):
    return run_list(spark, sf).where({"search": ["MACH", "#0000001"]}).select("run_id")


@query("runs_outside_batches", "SELECT run_id, origin FROM lruns WHERE batch_id IS NULL AND weight > 200000 AND status = 'NotRan'", ["lruns"])
def runs_outside_batches(spark, sf):
    return run_list(spark, sf).where({"batch": ["none"], "type": ["BLEU"], "status": ["NotRan"]}).select("run_id", "origin")


@query("members_and_others", """SELECT id, CASE WHEN id IN (SELECT scope_id FROM sbatches) THEN 'any' ELSE 'none' END AS batches FROM scopes
UNION ALL SELECT id, 'failed' FROM scopes WHERE id IN (SELECT scope_id FROM sbatches WHERE status = 'Failed')""", ["scopes", "sbatches"])
def members_and_others(spark, sf):
    scopes = world.scopes(spark, sf).select("id")
    related = world.scope_batches(spark, sf).select(F.col("scope_id").alias("id"), F.col("status").alias("value"))
    pick = lambda values, name: L.membership(scopes, related, "id", values).withColumn("batches", F.lit(name))
    return pick("any", "any").unionByName(pick("none", "none")).unionByName(pick(["Failed"], "failed"))


# ── standing ─────────────────────────────────────────────────────────────────

@query("runs_per_scope", "SELECT id AS scope_id, (SELECT count(*) FROM sruns r WHERE r.scope_id = s.id) AS count FROM scopes s", ["sruns", "scopes"])
def runs_per_scope(spark, sf):
    return keyed.count_by(world.scope_runs(spark, sf), "scope_id", world.scopes(spark, sf).select(F.col("id").alias("scope_id")))


@query("batches_with_runs", "SELECT DISTINCT batch_id FROM sruns WHERE batch_id IS NOT NULL", ["sruns"])
def batches_with_runs(spark, sf):
    return keyed.keys_with(world.scope_runs(spark, sf), "batch_id")


@query("latest_run_per_scope", "SELECT scope_id, run_id, status FROM sruns QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY created_at DESC, run_id DESC) = 1", ["sruns"])
def latest_run_per_scope(spark, sf):
    return keyed.latest_per(world.scope_runs(spark, sf), "scope_id", [F.desc("created_at"), F.desc("run_id")]).select("scope_id", "run_id", "status")


_COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS \"{s}\"" for s in STATUSES)


@query("run_counts_by_scope", f"SELECT scope_id, {_COUNTS} FROM sruns GROUP BY 1", ["sruns"])
def run_counts_by_scope(spark, sf):
    return S.run_counts_by(world.scope_runs(spark, sf), "scope_id")


@query("latest_batches", "SELECT scope_id, batch_id, status FROM sbatches QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY created_at DESC, batch_id DESC) = 1", ["sbatches"])
def latest_batches(spark, sf):
    return S.latest_batches(world.scope_batches(spark, sf)).select("scope_id", "batch_id", "status")


@query("latest_standalone_runs", "SELECT test_id, run_id, status FROM sruns WHERE test_id IS NOT NULL AND batch_id IS NULL QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY created_at DESC, run_id DESC) = 1", ["sruns"])
def latest_standalone_runs(spark, sf):
    return S.latest_runs(world.scope_runs(spark, sf)).select("test_id", "run_id", "status")


_OUT = "CASE WHEN count(*) FILTER (WHERE status IN ('Pending', 'Running')) > 0 THEN 'Running' WHEN bool_or(status = 'NotRan') THEN 'NotRan' WHEN bool_or(status = 'Red') THEN 'Red' WHEN bool_or(status = 'Amber') THEN 'Amber' WHEN bool_or(status = 'Green') THEN 'Green' END"


@query("execution_outcomes", f"SELECT execution_id, {_OUT} AS outcome FROM sruns WHERE execution_id IS NOT NULL GROUP BY 1", ["sruns"])
def execution_outcomes(spark, sf):
    return S.execution_outcome(world.scope_runs(spark, sf).filter("execution_id is not null"))


view("standing", f"""
SELECT s.*, l.execution_id AS last_execution, l.created_at AS last_at, coalesce(n.n, 0) AS executions, o.outcome AS last_outcome, b.batch_id AS last_batch, b.status AS last_verdict,
  b.created_at AS batch_at, s.id IN (SELECT scope_id FROM execs WHERE origin = 'test_set') AS has_runs
FROM scopes s
LEFT JOIN (SELECT * FROM execs WHERE origin = 'test_set' AND batch_id IS NULL QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY created_at DESC, execution_id DESC) = 1) l ON l.scope_id = s.id
LEFT JOIN (SELECT scope_id, count(*) AS n FROM execs WHERE origin = 'test_set' AND batch_id IS NULL GROUP BY 1) n ON n.scope_id = s.id
LEFT JOIN (SELECT execution_id, {_OUT} AS outcome FROM sruns GROUP BY 1) o ON o.execution_id = l.execution_id
LEFT JOIN (SELECT * FROM sbatches QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY created_at DESC, batch_id DESC) = 1) b ON b.scope_id = s.id""",
     ["scopes", "execs", "sruns", "sbatches"])


def _standing(spark, sf):
    sets = world.executions(spark, sf).filter("origin = 'test_set'")
    return S.scope_standing(world.scopes(spark, sf), sets, world.scope_runs(spark, sf), world.scope_batches(spark, sf))


_ST = "id, executions, last_execution, last_outcome, last_batch, last_verdict, has_runs"


@query("scope_standing", f"SELECT {_ST} FROM standing", ["standing"])
def scope_standing(spark, sf):
    return _standing(spark, sf).select(*_ST.split(", "))


def scope_list(spark, sf) -> L.Listing:
    return L.Listing(
        _standing(spark, sf), "id",
        filters={"verdict": L.among_or_absent("last_verdict", "none"), "outcome": L.among_or_absent("last_outcome", "never"),
                 "segment": L.among("segment"), "search": L.search("name")},
        facets_of={"verdict": L.Facet("last_verdict", absent="none"), "outcome": L.Facet("last_outcome", absent="never", fixed=("Running", "NotRan", "Red", "Amber", "Green")),
                   "segment": L.Facet("segment")},
        sorts={"latest": [F.desc_nulls_last("last_at")], "name": [F.lower("name")]})


@query("listed_scopes", "SELECT id, name, last_outcome FROM standing WHERE (last_outcome IN ('Red') OR last_outcome IS NULL) AND segment <> 'BUILDING' ORDER BY last_at DESC NULLS LAST, id LIMIT 200", ["standing"])
def listed_scopes(spark, sf):
    # every segment but one, as the filter takes them
    return scope_list(spark, sf).page({"outcome": ["Red", "never"], "segment": ["AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE"]}, "latest", 0, 200).select("id", "name", "last_outcome")


@query("scope_facets", """
WITH f AS (SELECT 'verdict' AS facet, coalesce(last_verdict, 'none') AS value, count(*) AS n FROM standing WHERE last_outcome IN ('Green', 'Amber') GROUP BY 2
UNION ALL SELECT 'outcome', coalesce(last_outcome, 'never'), count(*) FROM standing GROUP BY 2
UNION ALL SELECT 'segment', segment, count(*) FROM standing WHERE last_outcome IN ('Green', 'Amber') GROUP BY 2
UNION ALL SELECT 'outcome', s, 0 FROM (VALUES ('Running'), ('NotRan'), ('Red'), ('Amber'), ('Green')) v(s))
SELECT facet, value, CAST(sum(n) AS BIGINT) AS count FROM f GROUP BY 1, 2""", ["standing"])
def scope_facets(spark, sf):
    return scope_list(spark, sf).facets({"outcome": ["Green", "Amber"]})


def _copies(spark, sf):
    """Copies sets hold: lineitem pairs of supplier set and order customer stand
    in as (test, set); a returned line's copy is unlinked."""
    li = world.table(spark, sf, "lineitem").join(world.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.select(F.col("o_custkey").alias("test_id"), F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")).alias("test_set_id"))


view("copies_of", "SELECT o_custkey AS test_id, CASE WHEN l_returnflag <> 'R' THEN l_suppkey END AS test_set_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
view("tstanding", """
SELECT s.*, r.run_id AS last_run, r.status AS last_status, r.created_at AS run_at, b.batch_id AS last_batch, b.status AS last_verdict, b.created_at AS batch_at,
  s.id IN (SELECT test_id FROM sruns WHERE test_id IS NOT NULL) AS has_runs, coalesce(c.n, 0) AS copies, coalesce(c.s, 0) AS sets
FROM scopes s
LEFT JOIN (SELECT * FROM sruns WHERE test_id IS NOT NULL AND batch_id IS NULL QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY created_at DESC, run_id DESC) = 1) r ON r.test_id = s.id
LEFT JOIN (SELECT * FROM sbatches QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY created_at DESC, batch_id DESC) = 1) b ON b.scope_id = s.id
LEFT JOIN (SELECT test_id, count(*) AS n, count(DISTINCT test_set_id) AS s FROM copies_of GROUP BY 1) c ON c.test_id = s.id""",
     ["scopes", "sruns", "sbatches", "copies_of"])


def _test_standing(spark, sf):
    return S.test_standing(world.scopes(spark, sf), world.scope_runs(spark, sf), world.scope_batches(spark, sf), _copies(spark, sf))


@query("test_standing", "SELECT id, last_run, last_status, last_batch, last_verdict, has_runs, copies, sets FROM tstanding", ["tstanding"])
def test_standing(spark, sf):
    return _test_standing(spark, sf).select("id", "last_run", "last_status", "last_batch", "last_verdict", "has_runs", "copies", "sets")


def test_list(spark, sf) -> L.Listing:
    t = (_test_standing(spark, sf).withColumn("created_at", F.lit(_ts("1994-01-01")))
         .withColumn("activity", S.activity()).withColumn("in_set", F.when(F.col("sets") > 0, "yes").otherwise("no")))
    return L.Listing(t, "id",
                     filters={"run": L.among_or_absent("last_status", "never"), "verdict": L.among_or_absent("last_verdict", "none"),
                              "in_set": L.among("in_set"), "search": L.search("name", "segment")},
                     facets_of={"run": L.Facet("last_status", absent="never"), "verdict": L.Facet("last_verdict", absent="none"), "in_set": L.Facet("in_set", fixed=("yes", "no"))},
                     sorts={"activity": [F.desc("activity")], "name": [F.lower("name")]})


@query("listed_tests", """SELECT id, name, strftime(coalesce(greatest(run_at, batch_at), TIMESTAMP '1994-01-01'), '%Y-%m-%d') AS active FROM tstanding
WHERE (last_status IN ('Red', 'Green') OR last_status IS NULL) AND contains(lower(segment), 'a')
ORDER BY coalesce(greatest(run_at, batch_at), TIMESTAMP '1994-01-01') DESC, id LIMIT 150 OFFSET 10""", ["tstanding"])
def listed_tests(spark, sf):
    return test_list(spark, sf).page({"run": ["Red", "Green", "never"], "search": ["A"]}, "activity", 10, 150).select(
        "id", "name", F.date_format("activity", "yyyy-MM-dd").alias("active"))


@query("test_facets", """
WITH f AS (SELECT 'run' AS facet, coalesce(last_status, 'never') AS value, count(*) AS n FROM tstanding WHERE last_verdict IS NULL GROUP BY 2
UNION ALL SELECT 'verdict', coalesce(last_verdict, 'none'), count(*) FROM tstanding GROUP BY 2
UNION ALL SELECT 'in_set', CASE WHEN sets > 0 THEN 'yes' ELSE 'no' END, count(*) FROM tstanding WHERE last_verdict IS NULL GROUP BY 2
UNION ALL SELECT 'in_set', s, 0 FROM (VALUES ('yes'), ('no')) v(s))
SELECT facet, value, CAST(sum(n) AS BIGINT) AS count FROM f GROUP BY 1, 2""", ["tstanding"])
def test_facets(spark, sf):
    return test_list(spark, sf).facets({"verdict": ["none"]})


def batch_list(spark, sf) -> L.Listing:
    return L.Listing(world.scope_batches(spark, sf), "batch_id", filters={"status": L.among("status"), "scope": L.among("scope_id")},
                     facets_of={"status": L.Facet("status", fixed=("Pending", "Running", "Passed", "Failed", "Inconclusive", "NotRan", "Incomplete", "Done"))},
                     sorts={"newest": [F.desc("created_at")]})


@query("listed_batches", "SELECT batch_id, status, runs FROM sbatches WHERE status IN ('Failed', 'Running') ORDER BY created_at DESC, batch_id LIMIT 120", ["sbatches"])
def listed_batches(spark, sf):
    return batch_list(spark, sf).page({"status": ["Failed", "Running"]}, "newest", 0, 120).select("batch_id", "status", "runs")


@query("batch_facets", """WITH f AS (SELECT status AS value, count(*) AS n FROM sbatches GROUP BY 1 UNION ALL
SELECT s, 0 FROM (VALUES ('Pending'), ('Running'), ('Passed'), ('Failed'), ('Inconclusive'), ('NotRan'), ('Incomplete'), ('Done')) v(s))
SELECT 'status' AS facet, value, CAST(sum(n) AS BIGINT) AS count FROM f GROUP BY 2""", ["sbatches"])
def batch_facets(spark, sf):
    return batch_list(spark, sf).facets({"status": ["Failed"]})


@query("listed_comparisons", """
WITH b AS (SELECT *, CAST(split_part(batch_id, '-', 3) AS INTEGER) AS yr FROM sbatches),
c AS (SELECT a.batch_id || '/' || b.batch_id AS id, a.batch_id AS batch_a, b.batch_id AS batch_b, a.scope_id,
  CASE WHEN a.status = b.status THEN 'no_difference' WHEN b.status = 'Passed' THEN 'better' WHEN a.status = 'Passed' THEN 'worse' ELSE 'inconclusive' END AS outcome,
  b.created_at FROM b a JOIN b ON b.scope_id = a.scope_id AND b.yr = a.yr + 1)
SELECT id, batch_a, batch_b, outcome FROM c WHERE outcome IN ('worse', 'no_difference') ORDER BY created_at DESC, id LIMIT 300""", ["sbatches"])
def listed_comparisons(spark, sf):
    return _comparisons(spark, sf).page({"outcome": ["worse", "no_difference"]}, "newest", 0, 300).select("id", "batch_a", "batch_b", "outcome")


def _comparisons(spark, sf):
    b = world.scope_batches(spark, sf).withColumn("yr", F.split("batch_id", "-")[2].cast("int"))
    a = b.select(F.col("batch_id").alias("batch_a"), "scope_id", (F.col("yr") + 1).alias("yr"), F.col("status").alias("sa"))
    c = a.join(b.withColumnsRenamed({"batch_id": "batch_b", "status": "sb"}), ["scope_id", "yr"])
    outcome = F.when(F.col("sa") == F.col("sb"), "no_difference").when(F.col("sb") == "Passed", "better").when(F.col("sa") == "Passed", "worse").otherwise("inconclusive")
    rows = c.withColumn("id", F.concat_ws("/", "batch_a", "batch_b")).withColumn("outcome", outcome)
    return listings.comparison_listing(rows, {"y1997": _ts("1997-01-01")})


@query("comparison_facets", """
WITH b AS (SELECT *, CAST(split_part(batch_id, '-', 3) AS INTEGER) AS yr FROM sbatches),
c AS (SELECT a.batch_id AS batch_a, b.batch_id AS batch_b, b.created_at,
  CASE WHEN a.status = b.status THEN 'no_difference' WHEN b.status = 'Passed' THEN 'better' WHEN a.status = 'Passed' THEN 'worse' ELSE 'inconclusive' END AS outcome
  FROM b a JOIN b ON b.scope_id = a.scope_id AND b.yr = a.yr + 1),
f AS (SELECT 'outcome' AS facet, outcome AS value, count(*) AS n FROM c GROUP BY 2
UNION ALL SELECT 'outcome', s, 0 FROM (VALUES ('better'), ('worse'), ('no_difference'), ('inconclusive')) v(s)
UNION ALL SELECT 'batch', x, count(*) FROM (SELECT unnest([batch_a, batch_b]) AS x FROM c WHERE outcome = 'worse') GROUP BY 2
UNION ALL SELECT 'created', 'y1997', count(*) FROM c WHERE outcome = 'worse' AND created_at >= TIMESTAMP '1997-01-01'
UNION ALL SELECT 'created', 'before', count(*) FROM c WHERE outcome = 'worse' AND created_at < TIMESTAMP '1997-01-01')
SELECT facet, value, CAST(sum(n) AS BIGINT) AS count FROM f GROUP BY 1, 2""", ["sbatches"])
def comparison_facets(spark, sf):
    return _comparisons(spark, sf).facets({"outcome": ["worse"]})


# ── sets and plans ───────────────────────────────────────────────────────────

@query("described_sets", """SELECT n_nationkey AS id, n_name AS name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS entries,
  (SELECT count(*) FROM region WHERE r_regionkey = n_regionkey) AS plans FROM nation""")
def described_sets(spark, sf):
    n = world.table(spark, sf, "nation")
    sets = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    links = n.select(F.col("n_nationkey").alias("test_set_id"), F.col("n_regionkey").alias("plan_id"))
    return S.describe_sets(sets, world.entries(spark, sf), links)


@query("described_plans", """SELECT r_regionkey AS id, r_name AS name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS sets,
  (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS entries FROM region""")
def described_plans(spark, sf):
    n = world.table(spark, sf, "nation")
    plans = world.table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    links = n.select(F.col("n_nationkey").alias("test_set_id"), F.col("n_regionkey").alias("plan_id"))
    return S.describe_plans(plans, links, world.entries(spark, sf))


@query("plans_linking_sets", "SELECT n_nationkey AS test_set_id, r_regionkey AS plan_id, r_name AS plan_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def plans_linking_sets(spark, sf):
    plans = world.table(spark, sf, "region").select(F.col("r_regionkey").alias("plan_id"), F.col("r_name").alias("name"))
    return listings.plans_linking(world.table(spark, sf, "nation").select(F.col("n_nationkey").alias("test_set_id"), F.col("n_regionkey").alias("plan_id")), plans)


@query("scopes_by_holdings", """
SELECT id, name, strftime(last_at, '%Y-%m-%d') AS last_day FROM standing WHERE id IN (SELECT test_set_id FROM copies_of) AND (last_outcome IN ('Green', 'Red') OR last_outcome IS NULL)
ORDER BY last_at DESC NULLS LAST, id LIMIT 100""", ["standing", "copies_of"])
def scopes_by_holdings(spark, sf):
    """Sets that hold any copy, newest run first, from the package's listing."""
    held = _copies(spark, sf).filter("test_set_id is not null").groupBy(F.col("test_set_id").alias("id")).agg(F.collect_set("test_id").alias("tests"))
    none = F.array().cast("array<long>")
    scopes = _standing(spark, sf).select("id", "name").join(held, "id", "left").withColumns({"plans": none, "sets": none, "created_at": F.lit(_ts("1994-01-01"))})
    listing = listings.scope_listing(scopes, _standing(spark, sf).select("id", "last_verdict", "last_outcome", "last_at"))
    return listing.page({"holds_test": ["any"], "outcome": ["Green", "Red", "never"]}, "latest", 0, 100).select("id", "name", F.date_format("last_at", "yyyy-MM-dd").alias("last_day"))


@query("listed_entries", "SELECT entry_id, name, test_set_name FROM entries WHERE plan_id IN (1, 3) ORDER BY lower(name), entry_id LIMIT 60", ["entries"])
def listed_entries(spark, sf):
    listing = L.Listing(world.entries(spark, sf), "entry_id", filters={"plan": L.among("plan_id")}, sorts={"name": [F.lower("name")]})
    return listing.page({"plan": [1, 3]}, "name", 0, 60).select("entry_id", "name", "test_set_name")


@query("listed_links", "SELECT n_nationkey AS test_set_id, n_name AS name, r_name AS plan FROM nation JOIN region ON r_regionkey = n_regionkey ORDER BY lower(n_name), n_nationkey LIMIT 20")
def listed_links(spark, sf):
    n, r = world.table(spark, sf, "nation"), world.table(spark, sf, "region")
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("test_set_id"), F.col("n_name").alias("name"), F.col("r_name").alias("plan"))
    return L.Listing(rows, "test_set_id", sorts={"name": [F.lower("name")]}).page({}, "name", 0, 20)


@query("listed_datasets", """
WITH d AS (SELECT source AS dataset_id, count(*) AS n, min_by(text, doc_id) AS first, count(*) FILTER (WHERE n_chars > 2000) AS made FROM documents GROUP BY 1)
SELECT dataset_id, n AS rows, made > 0 AS made, CASE WHEN n = 0 THEN '0' WHEN n <= 10 THEN '1-10' WHEN n <= 100 THEN '11-100' ELSE '101+' END AS size FROM d WHERE contains(lower(first), 'e') ORDER BY dataset_id LIMIT 500""")
def listed_datasets(spark, sf):
    return dataset_list(spark, sf).page({"search": ["e"]}, "name", 0, 500).select("dataset_id", "rows", "made", "size")


def dataset_list(spark, sf) -> L.Listing:
    d = world.table(spark, sf, "documents").groupBy(F.col("source").alias("dataset_id")).agg(
        F.count(F.lit(1)).alias("rows"), F.min_by("text", "doc_id").alias("first"), (F.count_if(F.col("n_chars") > 2000) > 0).alias("made"))
    ranges = {"0": F.col("rows") == 0, "1-10": F.col("rows").between(1, 10), "11-100": F.col("rows").between(11, 100), "101+": F.col("rows") > 100}
    size = F.coalesce(*[F.when(c, F.lit(n)) for n, c in ranges.items()])
    return L.Listing(d.withColumn("size", size), "dataset_id", filters={"size": L.among("size"), "search": L.search("dataset_id", "first"), "made": L.among("made")},
                     facets_of={"size": L.Facet("size", fixed=tuple(ranges)), "made": L.Facet("made")}, sorts={"name": [F.lower("dataset_id")]})


@query("dataset_facets", """
WITH d AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE n_chars > 2000) > 0 AS made FROM documents GROUP BY 1),
f AS (SELECT 'size' AS facet, CASE WHEN n = 0 THEN '0' WHEN n <= 10 THEN '1-10' WHEN n <= 100 THEN '11-100' ELSE '101+' END AS value, count(*) AS c FROM d GROUP BY 2
UNION ALL SELECT 'size', s, 0 FROM (VALUES ('0'), ('1-10'), ('11-100'), ('101+')) v(s)
UNION ALL SELECT 'made', CAST(made AS VARCHAR), count(*) FROM d WHERE n BETWEEN 11 AND 100 GROUP BY 2)
SELECT facet, value, CAST(sum(c) AS BIGINT) AS count FROM f GROUP BY 1, 2""")
def dataset_facets(spark, sf):
    return dataset_list(spark, sf).facets({"size": ["11-100"]})


@query("searched_dataset_rows", "SELECT id, dataset_id, position FROM drows WHERE contains(lower(input), 'the') AND (contains(lower(input), 'on') OR lower(expected_output) = 'on') ORDER BY position LIMIT 400", ["drows"])
def searched_dataset_rows(spark, sf):
    listing = L.Listing(world.dataset_rows(spark, sf), "id", filters={"search": L.search("input", "expected_output", "model_output")}, sorts={"number": [F.col("position")]})
    return listing.page({"search": ["The", "on"]}, "number", 0, 400).select("id", "dataset_id", "position")


# ── executions ───────────────────────────────────────────────────────────────

_XC = ", ".join(f"count(r.run_id) FILTER (WHERE r.status = '{s}') AS \"{s}\"" for s in STATUSES)


@query("listed_executions", f"""SELECT e.execution_id, e.scope_id, e.origin, {_XC}, count(r.run_id) AS runs FROM execs e LEFT JOIN sruns r USING (execution_id) GROUP BY 1, 2, 3""", ["execs", "sruns"])
def listed_executions(spark, sf):
    runs = world.scope_runs(spark, sf)
    return S.list_executions(world.executions(spark, sf), runs).select("execution_id", "scope_id", "origin", *STATUSES, "runs")


@query("newest_executions", f"""WITH p AS (SELECT * FROM execs ORDER BY created_at DESC, execution_id DESC LIMIT 100 OFFSET 20)
SELECT p.execution_id, p.origin, count(r.run_id) AS runs, {_OUT} AS outcome FROM p LEFT JOIN sruns r USING (execution_id) GROUP BY 1, 2""", ["execs", "sruns"])
def newest_executions(spark, sf):
    e = world.executions(spark, sf)
    return S.newest_executions(e.filter("origin = 'test_set'"), e.filter("origin = 'test_plan'"), world.scope_runs(spark, sf), 20, 100).select(
        "execution_id", "origin", "runs", "outcome")


@query("execution_runs_worst_first", """SELECT run_id, execution_id, name, CASE status WHEN 'NotRan' THEN 0 WHEN 'Red' THEN 1 WHEN 'Amber' THEN 2 WHEN 'Green' THEN 3 WHEN 'Running' THEN 4 ELSE 5 END AS rank
FROM sruns JOIN scopes ON id = scope_id WHERE execution_id IS NOT NULL ORDER BY rank, lower(name), run_id LIMIT 500""", ["sruns", "scopes"])
def execution_runs_worst_first(spark, sf):
    names = world.scopes(spark, sf).select(F.col("id").alias("scope_id"), "name")
    runs = S.execution_runs(world.scope_runs(spark, sf).filter("execution_id is not null"), names)
    return L.Listing(runs, "run_id", sorts={"worst": [F.col("rank"), F.lower("name")]}).page({}, "worst", 0, 500).select("run_id", "execution_id", "name", "rank")


@query("execution_checks", """
SELECT batch_id, entry_id, 'met' AS kind, NULL AS run_id, NULL AS label, count(*) FILTER (WHERE passed AND NOT errored) AS count FROM ran GROUP BY 1, 2
UNION ALL SELECT batch_id, entry_id, 'unmet', run_id, label, NULL FROM ran WHERE NOT (passed AND NOT errored)
UNION ALL SELECT batch_id, entry_id, 'not_ran', run_id, NULL, 3 FROM runs_b WHERE status = 'NotRan'""", ["ran", "runs_b"])
def execution_checks(spark, sf):
    told = world.told_results(spark, sf)
    return S.execution_checks(world.ran_results(spark, sf, told), world.batch_runs(spark, sf, told), ["batch_id", "entry_id"])


@query("run_details", """SELECT b.run_id, b.status, e.name, e.input, e.expected_output, strftime(x.created_at, '%Y-%m-%d') AS executed
FROM runs_b b JOIN entries e USING (entry_id) LEFT JOIN (SELECT DISTINCT ON (scope_id) scope_id, created_at FROM execs WHERE origin = 'test_set' ORDER BY scope_id, execution_id) x ON x.scope_id = b.entry_id""", ["runs_b", "entries", "execs"])
def run_details(spark, sf):
    ex = keyed.latest_per(world.executions(spark, sf).filter("origin = 'test_set'"), "scope_id", [F.asc("execution_id")])
    ex = ex.select(F.col("scope_id").alias("execution_id"), "origin", "created_at")
    runs = world.batch_runs(spark, sf).withColumn("execution_id", F.col("entry_id"))
    copies = world.entries(spark, sf).select("entry_id", "name", "input", "expected_output")
    return S.run_details(runs, copies, ex).select("run_id", "status", "name", "input", "expected_output", F.date_format("execution_at", "yyyy-MM-dd").alias("executed"))


@query("test_run_history", "SELECT run_id, test_id, status FROM sruns WHERE test_id IS NOT NULL AND batch_id IS NULL ORDER BY created_at DESC, run_id LIMIT 250", ["sruns"])
def test_run_history(spark, sf):
    runs = world.scope_runs(spark, sf).filter("test_id is not null")
    return L.Listing(runs, "run_id", filters={"batch": L.batch_filter()}, sorts={"newest": [F.desc("created_at")]}).page({"batch": ["none"]}, "newest", 0, 250).select("run_id", "test_id", "status")
