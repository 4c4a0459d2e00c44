"""The listings of the package: runs, tests, and scopes (sets or plans).

Each is declared over its own rows; what other tables add are lookups, joined
only where a filter, a facet, a sort or the shown columns read them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import RUN_STATUSES
from . import listing as L
from .standing import status_rank

ORIGINS = ("standalone", "test_set", "test_plan")
BATCH_STATUSES = ("Pending", "Running", "Passed", "Failed", "Inconclusive", "NotRan", "Incomplete", "Done")


def _buckets(edges: dict | None) -> dict[str, L.Facet]:
    return {"created": L.Facet(buckets=L.created_buckets("created_at", edges))} if edges else {}


def run_listing(runs: DataFrame, tests: DataFrame, entries: DataFrame, sets: DataFrame, plans: DataFrame, batches: DataFrame,
                datasets: DataFrame, edges: dict | None = None) -> L.Listing:
    """Runs with their names. `runs`: run_id, status, created_at, test_id,
    entry_id, set_id, plan_id, batch_id, and types, the check types a run asks.
    Six lookups: the standalone test, the entry's snapshot, set, plan, batch,
    and the dataset a test came from; the shown name is the test's, else the
    entry's. `edges` names moments the created facet counts from."""
    lookups = {"test": L.Lookup(tests, "test_id", "test_id", {"test_name": "name", "_dataset": "dataset_id"}),
               "entry": L.Lookup(entries, "entry_id", "entry_id", {"entry_name": "name"}),
               "set": L.Lookup(sets, "set_id", "set_id", {"set_name": "name"}), "plan": L.Lookup(plans, "plan_id", "plan_id", {"plan_name": "name"}),
               "batch": L.Lookup(batches, "batch_id", "batch_id", {"batch_status": "status"}),
               "dataset": L.Lookup(datasets, "_dataset", "dataset_id", {"dataset_name": "name"})}
    named, scoped = ("test", "entry"), ("set", "plan")
    return L.Listing(
        runs.withColumn("origin", L.origin()), "run_id",
        filters={"status": L.among("status"), "origin": L.among("origin"), "batch": L.batch_filter(), "set": L.among("set_id"), "plan": L.among("plan_id"),
                 "type": L.holds_any("types"), "created": L.created(), "search": L.search("name", "scope_name"), "verdict": L.among_or_absent("batch_status", "none"),
                 "dataset": L.among_or_absent("dataset_name", "none")},
        facets_of={"status": L.Facet("status", fixed=RUN_STATUSES), "origin": L.Facet("origin", fixed=ORIGINS), "type": L.Facet("types", array=True),
                   "batch": L.Facet(buckets={"none": F.col("batch_id").isNull(), "any": F.col("batch_id").isNotNull()}), **_buckets(edges)},
        sorts={"newest": [F.desc("created_at")], "name": [F.lower("name")], "worst": [status_rank(), F.lower("name")]},
        lookups=lookups, shows=named + scoped,
        reads={"search": named + scoped, "name": named, "worst": named, "verdict": ("batch",), "dataset": ("test", "dataset")},
        derived={"name": (F.coalesce("test_name", "entry_name"), named), "scope_name": (F.coalesce("plan_name", "set_name"), scoped)})


def test_listing(tests: DataFrame, standing: DataFrame, datasets: DataFrame, edges: dict | None = None) -> L.Listing:
    """Tests with where they stand. `tests`: test_id, name, input,
    model_output, dataset_id, row_position, created_at and assignments (name,
    label); `standing`: id, last_status, run_at, last_verdict, batch_at, sets."""
    latest = L.Lookup(standing, "test_id", "id", {c: c for c in ("last_status", "run_at", "last_verdict", "batch_at", "sets")})
    own = tests.withColumns({"types": F.transform("assignments", lambda a: a["name"]), "answer": F.when(F.col("model_output").isNotNull(), "recorded").otherwise("asked"),
                             "_labels": F.array_join(F.transform("assignments", lambda a: F.concat_ws(" ", a["name"], a["label"])), "\n")})
    now = ("latest",)
    in_set = F.when(F.coalesce(F.col("sets"), F.lit(0)) > 0, "yes").otherwise("no")
    activity = F.coalesce(F.greatest("run_at", "batch_at"), F.col("created_at"))
    return L.Listing(
        own, "test_id",
        filters={"type": L.holds_any("types"), "verdict": L.among_or_absent("last_verdict", "none"), "run": L.among_or_absent("last_status", "never"),
                 "answer": L.among("answer"), "in_set": L.among("in_set"), "dataset": L.among_or_absent("dataset_id", "none"), "created": L.created(),
                 "search": L.search("name", "input", "_labels")},
        facets_of={"type": L.Facet("types", array=True, absent="none"), "verdict": L.Facet("last_verdict", absent="none"), "run": L.Facet("last_status", absent="never"),
                   "answer": L.Facet("answer", fixed=("recorded", "asked")), "in_set": L.Facet("in_set", fixed=("yes", "no")), "dataset": L.Facet("dataset_id", absent="none"), **_buckets(edges)},
        sorts={"activity": [F.desc("activity")], "name": [F.lower("name")], "created": [F.desc("created_at")],
               "dataset_row": [F.asc_nulls_last("dataset_name"), F.asc_nulls_last("row_position")]},
        lookups={"latest": latest, "dataset": L.Lookup(datasets, "dataset_id", "dataset_id", {"dataset_name": "name"})}, shows=now,
        reads={"verdict": now, "run": now, "in_set": now, "activity": now, "dataset_row": ("dataset",)},
        derived={"in_set": (in_set, now), "activity": (activity, now)})


def scope_listing(scopes: DataFrame, standing: DataFrame, edges: dict | None = None) -> L.Listing:
    """Sets or plans. `scopes`: id, name, created_at and the arrays plans,
    tests and sets of what links or holds them (empty where it does not
    apply); `standing`: id, last_verdict, last_outcome, last_at."""
    now = ("latest",)
    return L.Listing(
        scopes, "id",
        filters={"verdict": L.among_or_absent("last_verdict", "none"), "outcome": L.among_or_absent("last_outcome", "never"), "in_plan": L.holds_any("plans"),
                 "holds_test": L.holds_any("tests"), "holds_set": L.holds_any("sets"), "created": L.created(), "search": L.search("name")},
        facets_of={"verdict": L.Facet("last_verdict", absent="none"), "outcome": L.Facet("last_outcome", absent="never", fixed=("Running", "NotRan", "Red", "Amber", "Green")), **_buckets(edges)},
        sorts={"latest": [F.desc_nulls_last("last_at")], "created": [F.desc("created_at")], "name": [F.lower("name")]},
        lookups={"latest": L.Lookup(standing, "id", "id", {c: c for c in ("last_verdict", "last_outcome", "last_at")})}, shows=now,
        reads={"verdict": now, "outcome": now, "latest": now})


def comparison_listing(comparisons: DataFrame, edges: dict | None = None) -> L.Listing:
    """Comparisons: id, batch_a, batch_b, outcome, created_at."""
    return L.Listing(comparisons.withColumn("batches", F.array("batch_a", "batch_b")), "id",
                     filters={"outcome": L.among("outcome"), "batch": L.holds_any("batches"), "created": L.created()},
                     facets_of={"outcome": L.Facet("outcome", fixed=("better", "worse", "no_difference", "inconclusive")), "batch": L.Facet("batches", array=True), **_buckets(edges)},
                     sorts={"newest": [F.desc("created_at")]})


def plans_linking(links: DataFrame, plans: DataFrame) -> DataFrame:
    """(test_set_id, plan_id, plan_name): the plans that link each set; a link
    made twice counts once."""
    return links.select("test_set_id", "plan_id").distinct().join(plans.select("plan_id", F.col("name").alias("plan_name")), "plan_id").select("test_set_id", "plan_id", "plan_name")
