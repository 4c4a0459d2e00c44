"""Runs scored end to end."""
from proofmill.plans.jobs import score_runs
from proofmill.schemas import ASSIGNMENT
from proofmill.sources.catalogue import check_types


def test_runs_from_answers_to_outcomes(spark):
    def check(name, label, config=None, path=None):
        return (name, label, config or {}, path)
    has = check("Contains", "has", {"substring": "yes"})
    runs = spark.createDataFrame([
        (1, "Pending", "oh yes", None, [has], None), (2, "Pending", None, "yes", [has, check("Exact Match", "same")], None),
        (3, "Pending", None, None, [has], None), (4, "Pending", "no", None, [has], ["has"]),
        (5, "Pending", '{"a": "yes"}', None, [check("Contains", "part", {"substring": "yes"}, "$.a"), check("Contains", "gone", {"substring": "yes"}, "$.b")], None)],
        f"run_id int, status string, model_output string, expected_output string, assignments array<{ASSIGNMENT}>, skip_labels array<string>")
    replies = spark.createDataFrame([(2, '{"out": "yes sir"}'), (3, "<html>")], "run_id int, reply string")
    results, outcomes = score_runs(runs, replies, check_types(spark), "$.out", metrics=())
    got = {(r["run_id"], r["label"]): (r["passed"], r["detail"], r["errored"]) for r in results.collect()}
    assert got == {(1, "has"): (True, None, False), (2, "has"): (True, None, False), (2, "same"): (False, "differs", False),
                   (5, "part"): (True, None, False), (5, "gone"): (False, "nothing_at_path", True)}
    assert {r["run_id"]: (r["status"], r["error"]) for r in outcomes.collect()} == {
        1: ("Green", None), 2: ("Amber", None), 3: ("NotRan", "reply_not_json"), 4: ("Green", None), 5: ("Amber", None)}
