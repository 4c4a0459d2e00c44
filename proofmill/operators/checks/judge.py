"""The data side of judging by a model: rubrics, prompts, replies."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.jsonpath import kind_of
from ...functions.text import strip
from . import setting


def resolve_rubric(checks: DataFrame) -> DataFrame:
    """The check's own rubric when not blank, else its type's default; neither
    makes the check errored."""
    own = F.nullif(strip(F.col("config")["rubric"]), F.lit(""))
    default = F.nullif(strip(F.col("engine_settings")["default_rubric"]), F.lit(""))
    return checks.withColumns({
        "rubric": F.coalesce(own, default),
        "rubric_source": F.when(own.isNotNull(), "custom").when(default.isNotNull(), "default"),
        "errored": own.isNull() & default.isNull()})


def judge_prompts(checks: DataFrame) -> DataFrame:
    """The text a judge reads: rubric, question, the reference when the type
    asks for it, and the answer, each in tags. A type that asks for a missing
    reference is errored."""
    def tagged(tag, text):
        return F.concat(F.lit(f"<{tag}>\n"), text, F.lit(f"\n</{tag}>"))
    wants = setting("reference", False)
    prompt = F.concat_ws("\n\n", tagged("rubric", F.col("rubric")), tagged("question", F.col("input")),
                         F.when(wants, tagged("reference", F.col("reference"))), tagged("answer", F.col("answer")),
                         F.lit("Say whether the answer passes the rubric."))
    missing = wants & F.col("reference").isNull()
    bad = F.col("errored") | missing
    return checks.withColumns({"prompt": F.when(~bad, prompt), "errored": bad})


def parse_judge_replies(replies: DataFrame, body: str = "body") -> DataFrame:
    """passed, rationale and token counts out of stored replies, in either
    shape: content blocks with a tool input, or choices with a JSON message.
    A refusal, an unreadable body or wrong types make the check errored."""
    doc = F.try_parse_json(F.col(body))
    get = lambda v, path, kind: F.try_variant_get(v, F.lit(path), kind)
    parsed = replies.withColumn("_doc", doc)
    blocks = get(F.col("_doc"), "$.content", "array<variant>")
    tool = F.get(F.filter(blocks, lambda b: get(b, "$.type", "string") == "tool_use"), F.lit(0))
    said = get(F.col("_doc"), "$.choices[0].message.content", "string")
    verdict = F.coalesce(get(tool, "$.input", "variant"), F.try_parse_json(said))
    refused = (get(F.col("_doc"), "$.stop_reason", "string") == "refusal") | \
        get(F.col("_doc"), "$.choices[0].message.refusal", "string").isNotNull()
    out = parsed.withColumn("_v", verdict).withColumn("_refused", F.coalesce(refused, F.lit(False)))
    flag, why = get(F.col("_v"), "$.passed", "variant"), get(F.col("_v"), "$.rationale", "variant")
    problem = (F.when(F.col("_doc").isNull(), "unreadable").when(F.col("_refused"), "refused")
               .when(F.col("_v").isNull(), "no_verdict")
               .when(F.coalesce(kind_of(flag) != "boolean", F.lit(True)), "passed_not_boolean")
               .when(F.coalesce(kind_of(why) != "string", F.lit(True)), "rationale_not_text"))
    fine = problem.isNull()
    return out.withColumns({
        "passed": F.when(fine, get(flag, "$", "boolean")).otherwise(False),
        "rationale": F.when(fine, get(why, "$", "string")),
        "input_tokens": F.coalesce(get(F.col("_doc"), "$.usage.input_tokens", "long"), get(F.col("_doc"), "$.usage.prompt_tokens", "long")),
        "output_tokens": F.coalesce(get(F.col("_doc"), "$.usage.output_tokens", "long"), get(F.col("_doc"), "$.usage.completion_tokens", "long")),
        "errored": ~fine, "detail": problem}).drop("_doc", "_v", "_refused")
