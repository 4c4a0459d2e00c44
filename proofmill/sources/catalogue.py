"""Check types and statistical tests as small DataFrames, and their validation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CONFIG_FIELD, PARAMETER
from ..session import lit_frame

# Check types (name, category, engine, settings, comparison, fields)
_REF = ("reference", "reference", True, None, None, False)


def _threshold(low: float, high: float) -> tuple:
    return ("threshold", "numeric", True, low, high, False)


def _limits() -> list[tuple]:
    return [("max", "numeric", True, 0.0, None, True), ("min", "numeric", False, 0.0, None, True)]


def _text(key: str, kind: str, required: bool = True) -> tuple:
    return (key, kind, required, None, None, False)


def _s(**settings) -> dict[str, str]:
    return {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in settings.items()}


CHECK_TYPES = [
    ("BERTScore", "nlp_metric", "bertscore", _s(layer=5, measure="f1"), "gte", [_REF, _threshold(0.0, 1.0)]),
    ("BLEU", "nlp_metric", "bleu", _s(smooth_method="exp", lowercase=False), "gte", [_REF, _threshold(0.0, 100.0)]),
    ("BLEU (case-insensitive)", "nlp_metric", "bleu", _s(smooth_method="exp", lowercase=True), "gte", [_REF, _threshold(0.0, 100.0)]),
    ("Bias", "llm_as_judge", "llm_judge", _s(reference=False), None, [_text("rubric", "rubric", False)]),
    ("Character Count Limit", "deterministic", "length", _s(unit="characters"), None, _limits()),
    ("Contains", "deterministic", "contains", _s(case_sensitive=True, normalize_lookalikes=True), None, [_text("substring", "multiline")]),
    ("Contains (case-insensitive)", "deterministic", "contains", _s(case_sensitive=False, normalize_lookalikes=True), None, [_text("substring", "multiline")]),
    ("Correctness", "llm_as_judge", "llm_judge", _s(reference=True), None, [_REF, _text("rubric", "rubric", False)]),
    ("Cosine Similarity", "nlp_metric", "embedding_cosine", _s(), "gte", [_REF, _threshold(-1.0, 1.0)]),
    ("Cosine Similarity (multilingual)", "nlp_metric", "embedding_cosine", _s(), "gte", [_REF, _threshold(-1.0, 1.0)]),
    ("Does Not Contain", "deterministic", "contains", _s(case_sensitive=True, negate=True, normalize_lookalikes=True), None, [_text("substring", "multiline")]),
    ("Does Not Contain (case-insensitive)", "deterministic", "contains", _s(case_sensitive=False, negate=True, normalize_lookalikes=True), None, [_text("substring", "multiline")]),
    ("Exact Match", "deterministic", "exact_match", _s(trim=True, case_sensitive=True, normalize_lookalikes=True), None, [_REF]),
    ("Exact Match (case-insensitive)", "deterministic", "exact_match", _s(trim=True, case_sensitive=False, normalize_lookalikes=True), None, [_REF]),
    ("Exact Match (whitespace-sensitive)", "deterministic", "exact_match", _s(trim=False, case_sensitive=True, normalize_lookalikes=False), None, [_REF]),
    ("Hallucination", "llm_as_judge", "llm_judge", _s(reference=True), None, [_REF]),
    ("Is Valid JSON", "deterministic", "json", _s(check="valid", strip_fences=True), None, []),
    ("JSON Field Equals", "deterministic", "json", _s(check="field", strip_fences=True), None, [_text("path", "jsonpath"), _text("value", "json")]),
    ("METEOR", "nlp_metric", "meteor", _s(alpha=0.9, beta=3.0, gamma=0.5), "gte", [_REF, _threshold(0.0, 1.0)]),
    ("METEOR (balanced)", "nlp_metric", "meteor", _s(alpha=0.5, beta=3.0, gamma=0.5), "gte", [_REF, _threshold(0.0, 1.0)]),
    ("Matches JSON Schema", "deterministic", "json", _s(check="schema", strip_fences=True), None, [_text("schema", "json_schema")]),
    ("ROUGE", "nlp_metric", "rouge", _s(variant="rougeL", measure="f1", stemmer=True), "gte", [_REF, _threshold(0.0, 1.0)]),
    ("ROUGE-1", "nlp_metric", "rouge", _s(variant="rouge1", measure="f1", stemmer=True), "gte", [_REF, _threshold(0.0, 1.0)]),
    ("ROUGE-2", "nlp_metric", "rouge", _s(variant="rouge2", measure="f1", stemmer=True), "gte", [_REF, _threshold(0.0, 1.0)]),
    ("ROUGE-L Precision", "nlp_metric", "rouge", _s(variant="rougeL", measure="precision", stemmer=True), "gte", [_REF, _threshold(0.0, 1.0)]),
    ("ROUGE-L Recall", "nlp_metric", "rouge", _s(variant="rougeL", measure="recall", stemmer=True), "gte", [_REF, _threshold(0.0, 1.0)]),
    ("Regex Full Match", "deterministic", "regex", _s(mode="fullmatch", normalize_lookalikes=True), None, [_text("pattern", "regex")]),
    ("Regex Match", "deterministic", "regex", _s(mode="search", normalize_lookalikes=True), None, [_text("pattern", "regex")]),
    ("Regex Must Not Match", "deterministic", "regex", _s(mode="search", negate=True, normalize_lookalikes=True), None, [_text("pattern", "regex")]),
    ("Relevance", "llm_as_judge", "llm_judge", _s(reference=False), None, [_text("rubric", "rubric", False)]),
    ("Toxicity", "llm_as_judge", "llm_judge", _s(reference=False), None, [_text("rubric", "rubric", False)]),
    ("Word Count Limit", "deterministic", "length", _s(unit="words"), None, _limits()),
]

# Statistical tests (id, engine, parameters, settings)
_LEVEL = ("confidence", "level", 0.95, 0.8, 0.999)
STAT_TESTS = [
    ("binomial_gate", "binomial_gate", [("target", "rate", 0.9, 0.5, 0.999), _LEVEL], {}),
    ("one_sample_t", "one_sample_t", [_LEVEL, ("difference", "share", 0.05, 0.005, 1.0), ("spread", "share", 0.1, 0.001, 1.0)],
     {"floor": "10", "recommended_times": "30"}),
    ("judge_stability", "judge_stability", [("target", "rate", 0.9, 0.6, 0.999), _LEVEL], {}),
    ("pass_rates", "pass_rates", [_LEVEL], {}),
    ("no_worse", "no_worse", [("margin", "share", 0.05, 0.01, 0.5), _LEVEL], {}),
    ("mean_scores", "mean_scores", [_LEVEL], {"recommended_times": "30"}),
    ("score_ranks", "score_ranks", [_LEVEL], {"recommended_times": "30"}),
    ("paired_entries", "paired_entries", [_LEVEL], {}),
    ("trial", "trial", [], {"default_times": "10", "max_times": "50"}),
    ("sequential_gate", "sequential_gate", [("target", "rate", 0.9, 0.5, 0.999), _LEVEL], {}),
    ("sequential_judge_stability", "sequential_judge_stability", [("target", "rate", 0.9, 0.6, 0.999), _LEVEL], {}),
    ("sequential_t", "sequential_t", [_LEVEL], {"floor": "10"}),
]

# What each statistical engine takes (parameter -> kind) and which
# settings it may (False) or must (True) have
STAT_ENGINES = [
    ("binomial_gate", {"target": "rate", "confidence": "level"}, {}),
    ("one_sample_t", {"confidence": "level", "difference": "share", "spread": "share"}, {"floor": True, "recommended_times": True}),
    ("judge_stability", {"target": "rate", "confidence": "level"}, {}),
    ("pass_rates", {"confidence": "level"}, {}),
    ("no_worse", {"margin": "share", "confidence": "level"}, {}),
    ("mean_scores", {"confidence": "level"}, {"recommended_times": False}),
    ("score_ranks", {"confidence": "level"}, {"recommended_times": False}),
    ("paired_entries", {"confidence": "level"}, {}),
    ("trial", {}, {"default_times": True, "max_times": True}),
    ("sequential_gate", {"target": "rate", "confidence": "level"}, {}),
    ("sequential_judge_stability", {"target": "rate", "confidence": "level"}, {}),
    ("sequential_t", {"confidence": "level"}, {"floor": True}),
]


def check_types(spark: SparkSession) -> DataFrame:
    return lit_frame(spark, CHECK_TYPES, "name string, category string, engine string, engine_settings map<string,string>, "
                                         f"comparison string, config_fields array<{CONFIG_FIELD}>")


def stat_tests(spark: SparkSession) -> DataFrame:
    return lit_frame(spark, STAT_TESTS, f"id string, engine string, parameters array<{PARAMETER}>, "
                                        "engine_settings map<string,string>")


def engine_specs(spark: SparkSession) -> DataFrame:
    return lit_frame(spark, STAT_ENGINES, "engine string, takes map<string,string>, reads map<string,boolean>")


def check_types_by_category(types: DataFrame, category: str | None) -> DataFrame:
    """Check types of one category (or all), name descending."""
    rows = types if category is None else types.filter(F.col("category") == category)
    return rows.orderBy(F.desc("name"))


def _problems(*pairs: tuple[Column, Column]) -> Column:
    """The texts whose condition holds."""
    return F.array_compact(F.array(*[F.when(cond, text) for cond, text in pairs]))


def validate_catalogue(tests: DataFrame, specs: DataFrame) -> DataFrame:
    """One row per problem (id, problem): unknown engine, wrong parameters or
    kinds, a default outside its range, wrong settings or setting values."""
    specs = specs.withColumn("_known", F.lit(True))
    joined = tests.join(specs, "engine", "left")
    keys = F.array_sort(F.transform("parameters", lambda p: p["key"]))
    settings = F.coalesce("engine_settings", F.create_map().cast("map<string,string>"))
    number = lambda k: settings[k].try_cast("int")
    found = joined.select("id", F.when(F.col("_known").isNull(), F.array(F.lit("unknown_engine"))).otherwise(F.concat(
        _problems((keys != F.array_sort(F.map_keys("takes")), F.lit("parameters"))),
        F.transform(F.filter("parameters", lambda p: F.col("takes")[p["key"]] != p["kind"]),
                    lambda p: F.concat(F.lit("kind:"), p["key"])),
        F.transform(F.filter("parameters", lambda p: ~p["default"].between(p["min"], p["max"])),
                    lambda p: F.concat(F.lit("default:"), p["key"])),
        F.transform(F.array_sort(F.array_except(F.map_keys(settings), F.map_keys("reads"))),
                    lambda k: F.concat(F.lit("unknown_setting:"), k)),
        F.transform(F.array_sort(F.filter(F.map_keys("reads"), lambda k: F.col("reads")[k] & ~F.array_contains(F.map_keys(settings), k))),
                    lambda k: F.concat(F.lit("missing_setting:"), k)),
        F.transform(F.array_sort(F.filter(F.map_keys(settings), lambda k: F.coalesce(settings[k].try_cast("int") < 2, F.lit(True)))),
                    lambda k: F.concat(F.lit("setting_value:"), k)),
        _problems((F.coalesce(number("recommended_times") < number("floor"), F.lit(False)), F.lit("recommended_below_floor"))),
    )).alias("_p"))
    return found.select("id", F.explode("_p").alias("problem"))
