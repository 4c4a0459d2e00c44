"""Whole jobs: scoring runs, and judging batches."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.answers import answer_for_check, mark_not_ran, resolve_answer
from ..operators.batch import fold_results, gate
from ..operators.checks.dispatch import Sides, score_checks
from ..operators.fanout import asked_checks
from ..operators.rollup import roll_up_runs


def gate_batches(results: DataFrame, target: float, confidence: float) -> DataFrame:
    """Which checks pass at least `target` of the time: one shuffle of counts,
    then arithmetic on the groups."""
    return gate(fold_results(results), target, confidence)


def score_runs(runs: DataFrame, replies: DataFrame, types: DataFrame, output_path: str = "$",
               metrics: tuple[str, ...] = ("rouge", "bleu", "meteor"), sides: Sides | None = None,
               schemas: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(check results, run outcomes) of pending runs: pick each answer, read
    each check's part of it, score, roll up. Runs without an answer are NotRan
    with the reason. `runs` carries run_id, status, model_output,
    expected_output, assignments and skip_labels. `sides` carries vectors,
    token vectors, judge replies and synonyms by (run, label)."""
    answered = mark_not_ran(resolve_answer(runs, replies, output_path))
    asked = asked_checks(answered.filter(F.col("answer").isNotNull())).withColumn("reference", F.col("expected_output"))
    results = score_checks(answer_for_check(asked), types, schemas=schemas, metrics=metrics, sides=sides)
    scored = roll_up_runs(results, answered.filter(F.col("answer").isNotNull()))
    idle = answered.filter(F.col("answer").isNull()).select("run_id", "status", "error")
    return results, scored.withColumn("error", F.lit(None).cast("string")).unionByName(idle)
