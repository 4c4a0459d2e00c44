"""Sends each assigned check to its engine by its catalogue row.

All built-in engines share one pass: a check is one row with its texts, the
settings of its type and, where it needs them, side inputs of its own (run,
label): vectors, token vectors, a judge's reply. They come as nullable columns
of that row from one join; every wording metric counts in one Arrow function,
vectors in another, the rest is one projection.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.text import strip
from . import RESULT, option, outcome, setting, threshold_columns
from .fixed import contains_columns, exact_columns, json_columns, length_columns, regex_columns, with_plain_texts
from .judge import parse_judge_replies
from .overlap import KEYS, ROUGE_VARIANT, bleu_score, counted_by, meteor_score, rouge_score, shaped, synonym_groups
from .vectors import cosine, token_match, token_score

# engines anyone added: name -> a DataFrame function under the check contract
_ADDED: dict[str, Callable[[DataFrame], DataFrame]] = {}
FIXED = ("exact_match", "contains", "regex", "json", "length")
METRICS = ("rouge", "bleu", "meteor")
VECTOR, TOKENS, JUDGE = "embedding_cosine", "bertscore", "llm_judge"


@dataclass
class Sides:
    """What checks may need besides their texts, each with run_id and label:
    vectors (answer_vector, reference_vector), token_vectors (answer_vectors,
    reference_vectors), replies (body); and synonyms (word, group)."""

    vectors: DataFrame | None = None
    token_vectors: DataFrame | None = None
    replies: DataFrame | None = None
    synonyms: DataFrame | None = None


_SIDE = {"_va": "array<double>", "_vr": "array<double>", "_ta": "array<array<double>>", "_tr": "array<array<double>>", "_body": "string"}


def register_engine(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Adds an engine: `fn` takes check rows and adds passed, score, detail,
    errored. Catalogue rows may then name it."""
    if name in (*FIXED, *METRICS, VECTOR, TOKENS, JUDGE):
        raise ValueError(f"{name} is built in")
    _ADDED[name] = fn


def registered_engines() -> tuple[str, ...]:
    return tuple(_ADDED)


def _with_sides(rows: DataFrame, sides: Sides, spread: bool) -> DataFrame:
    """The rows with the five side columns, null where nothing is given. All
    sides become one table with a row for each (run, label), joined once."""
    given = []
    for table, names in ((sides.vectors, {"_va": "answer_vector", "_vr": "reference_vector"}),
                         (sides.token_vectors, {"_ta": "answer_vectors", "_tr": "reference_vectors"}), (sides.replies, {"_body": "body"})):
        if table is not None:
            given.append(table.select(*KEYS, *[(F.col(names[c]) if c in names else F.lit(None)).cast(t).alias(c) for c, t in _SIDE.items()]))
    if not given:  # texts are spread by run even where no side asks for it: scoring costs far more than moving
        rows = rows.repartition(*KEYS) if spread else rows
        return rows.withColumns({c: F.lit(None).cast(t) for c, t in _SIDE.items()})
    side = reduce(DataFrame.unionByName, given).groupBy(*KEYS).agg(*[F.first(c, True).alias(c) for c in _SIDE])
    return rows.join(side, KEYS, "left")


def _worded(rows: DataFrame, metrics: tuple[str, ...], synonyms: DataFrame | None) -> DataFrame:
    """Adds `_word`, the raw score of rows of the asked metrics."""
    metric = F.when(F.col("engine").isin(*metrics) & ~F.col("_early"), F.col("engine"))
    lower = setting("lowercase", False)
    variant = option("variant", "rougeL")
    out = rows.withColumn("_metric", metric)
    out = out.withColumns({"_left": shaped(F.col("_metric"), "answer", lower), "_right": shaped(F.col("_metric"), "reference", lower)})
    stemmed = (F.col("_metric") == "meteor") | setting("stemmer", True)
    out = out.withColumn("_o", counted_by(synonym_groups(synonyms))("_metric", "_left", "_right", F.when(variant.rlike(ROUGE_VARIANT), variant), stemmed))
    number = lambda key, default: F.coalesce(F.col("engine_settings")[key], F.lit(default)).try_cast("double")
    alpha, beta, gamma = number("alpha", "0.9"), number("beta", "3.0"), number("gamma", "0.5")
    o, measure, smooth = F.col("_o"), option("measure", "f1"), option("smooth_method", "exp")
    unknown = (F.when(F.col("_metric") == "rouge", ~variant.rlike(ROUGE_VARIANT) | ~measure.isin("f1", "precision", "recall"))
               .when(F.col("_metric") == "bleu", ~smooth.isin("exp", "floor", "add-k", "none"))
               .when(F.col("_metric") == "meteor", alpha.isNull() | beta.isNull() | gamma.isNull()))
    score = (F.when(F.col("_metric") == "rouge", rouge_score(o, measure)).when(F.col("_metric") == "bleu", bleu_score(o, smooth))
             .when(F.col("_metric") == "meteor", meteor_score(o, alpha, beta, gamma)))
    return out.withColumns({"_word": score, "_unknown": F.coalesce(unknown, F.lit(False))}).drop("_left", "_right", "_o", "_metric")


def _vectored(rows: DataFrame, sides: Sides) -> DataFrame:
    """Adds `_near`, the likeness of vectors or of token vectors."""
    near = F.when(F.col("engine") == VECTOR, F.when(strip(F.col("answer")) == "", 0.0).otherwise(
        F.when(F.size("_va") == F.size("_vr"), cosine(F.col("_va"), F.col("_vr")))))
    if sides.token_vectors is not None:
        mine = F.col("engine") == TOKENS
        rows = rows.withColumn("_pr", token_match(F.when(mine, F.col("_ta")), F.when(mine, F.col("_tr"))))
        both = F.when(F.col("_ta").isNotNull() & F.col("_tr").isNotNull(), token_score(F.col("_pr"), option("measure", "f1")))
        base = F.col("engine_settings")["baseline"].try_cast("double")
        near = F.when(mine, F.when(base.isNotNull(), (both - base) / (1 - base)).otherwise(both)).otherwise(near)
    return rows.withColumn("_near", near)


def score_checks(checks: DataFrame, types: DataFrame, schemas: list[str] | None = None,
                 metrics: tuple[str, ...] = METRICS, sides: Sides | None = None) -> DataFrame:
    """Scores every row of `checks` (run_id, label, test_type, answer,
    reference, config). A check already errored keeps its reason; an unknown
    type or engine, or a metric not asked for, is errored.

    A vector check without vectors is errored (no_vectors), a judge's without
    a rubric, a reference it reads, or a reply as well. Each added engine is
    one more branch over its own rows.
    """
    sides = sides or Sides()
    rows = checks.join(types.select(F.col("name").alias("test_type"), "engine", "engine_settings", "comparison"),
                       "test_type", "left")
    rows = rows if "errored" in checks.columns else rows.withColumn("errored", F.lit(False)).withColumn("detail", F.lit(None).cast("string"))
    rows = rows.withColumnsRenamed({"errored": "_early", "detail": "_why"})
    metrics = tuple(m for m in metrics if m in METRICS)
    built_in = (*FIXED, *metrics, VECTOR, TOKENS, JUDGE)
    added = F.coalesce(F.col("engine").isin(*_ADDED), F.lit(False)) & ~F.col("_early") if _ADDED else F.lit(False)
    here = with_plain_texts(_with_sides(rows.filter(~added), sides, bool(metrics)))
    here = _worded(here, metrics, sides.synonyms) if metrics else here.withColumns({"_word": F.lit(None).cast("double"), "_unknown": F.lit(False)})
    here = _vectored(here, sides)
    here = parse_judge_replies(here, "_body").withColumnsRenamed({"passed": "_said", "detail": "_unsaid"}).drop("rationale", "input_tokens", "output_tokens", "errored")
    here = here.withColumn("_score4", F.round(F.coalesce("_word", "_near"), 4))
    t_error, t_passed, t_miss = threshold_columns(F.col("_score4"))
    rubric = F.coalesce(F.nullif(strip(F.col("config")["rubric"]), F.lit("")), F.nullif(strip(F.col("engine_settings")["default_rubric"]), F.lit("")))
    judge_error = (F.when(rubric.isNull(), "no_rubric").when(setting("reference", False) & F.col("reference").isNull(), "no_reference")
                   .when(F.col("_body").isNull(), "no_reply").otherwise(F.col("_unsaid")))
    near_error = F.coalesce(t_error, F.when(F.col("_score4").isNull(), "no_vectors"))
    engines = {"exact_match": exact_columns(plain=True), "contains": contains_columns(plain=True), "regex": regex_columns(plain=True),
               "json": json_columns(schemas=schemas), "length": length_columns(),
               **{m: (F.when(F.col("_unknown"), "unknown_settings").otherwise(t_error), t_passed, t_miss) for m in metrics},
               VECTOR: (near_error, t_passed, t_miss), TOKENS: (near_error, t_passed, t_miss), JUDGE: (judge_error, F.col("_said"), F.lit("judged_not_passed"))}
    error = F.when(F.col("_early"), F.col("_why")).when(F.col("engine").isNull(), "unknown_type") \
        .when(~F.col("engine").isin(*built_in), "engine_not_available")
    passed, miss = F.lit(None).cast("boolean"), F.lit(None).cast("string")
    for name, (e, p, m) in engines.items():
        mine = F.col("engine") == name
        error = error.when(mine & e.isNotNull(), e)
        passed = F.when(mine, p).otherwise(passed)
        miss = F.when(mine, m).otherwise(miss)
    score = F.when(F.col("engine").isin(*metrics, VECTOR, TOKENS), F.col("_score4"))
    parts = [outcome(here, error, passed, miss, score)]
    parts += [fn(rows.filter((F.col("engine") == name) & ~F.col("_early"))) for name, fn in _ADDED.items()]
    keep = ["run_id", "label", "test_type", "engine", *RESULT]
    return reduce(DataFrame.unionByName, [p.select(*keep) for p in parts])
