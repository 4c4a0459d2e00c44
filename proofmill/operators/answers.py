"""Which answer a run is scored on, and what each check reads of it."""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonpath import answer_of, at_path, path_is_readable


def answer_at(text: Column, path: Column) -> Column:
    """The answer at a path of JSON text; null when nothing is there."""
    return answer_of(at_path(F.try_parse_json(text), path))


def resolve_answer(runs: DataFrame, replies: DataFrame, output_path: str = "$") -> DataFrame:
    """The recorded answer when there is one, else the application's reply read
    at the output path; with where it came from."""
    got = replies.select("run_id", F.col("reply").alias("application_reply"))
    found = answer_at(F.col("application_reply"), F.lit(output_path))
    recorded = F.col("model_output").isNotNull()
    out = runs.join(got, "run_id", "left")
    return out.withColumns({
        "answer": F.when(recorded, F.col("model_output")).otherwise(found),
        "output_source": F.when(recorded, "recorded").when(found.isNotNull(), "application"),
        "no_answer": F.when(recorded | found.isNotNull(), None).when(F.col("application_reply").isNull(), "no_reply")
        .when(F.try_parse_json("application_reply").isNull(), "reply_not_json").otherwise("nothing_at_output_path")})


def mark_not_ran(runs: DataFrame) -> DataFrame:
    """A run no answer could be had for did not run, with the reason."""
    return runs.withColumns({"status": F.when(F.col("answer").isNull(), "NotRan").otherwise(F.col("status")),
                             "error": F.when(F.col("answer").isNull(), F.col("no_answer"))})


def answer_for_check(checks: DataFrame) -> DataFrame:
    """What each check scores: the run's answer, or the part its own path names
    in the application's reply, or in a recorded answer that is JSON."""
    path = F.col("answer_path")
    whole = path.isNull() | (path == "")
    source = F.when(F.col("output_source") == "application", F.col("application_reply")).otherwise(F.col("answer"))
    part = answer_at(source, path)
    detail = (F.when(whole, None).when(~path_is_readable(path), "invalid_path")
              .when(F.try_parse_json(source).isNull(), "not_json").when(part.isNull(), "nothing_at_path"))
    return checks.withColumns({"answer": F.when(whole, F.col("answer")).otherwise(part), "detail": detail,
                               "errored": detail.isNotNull()})


def render_body(template: str, text: Column, placeholder: str = "{{input}}") -> Column:
    """A request body: the template's JSON with the text put inside its string
    values, as JSON text. Keys, numbers and shape stay as they are."""
    def piece(node) -> Column:
        if isinstance(node, str):
            if placeholder not in node:
                return F.lit(json.dumps(node, ensure_ascii=False))
            # the quotes around a JSON string are put back by escaping the whole text
            filled = F.replace(F.lit(node), F.lit(placeholder), text)
            return F.regexp_extract(F.to_json(F.struct(filled.alias("v"))), "(?s)^\\{\"v\":(.*)\\}$", 1)
        if isinstance(node, dict):
            parts: list[Column] = []
            for i, (key, value) in enumerate(node.items()):
                parts += [F.lit((", " if i else "") + json.dumps(key, ensure_ascii=False) + ": "), piece(value)]
            return F.concat(F.lit("{"), *parts, F.lit("}"))
        if isinstance(node, list):
            parts = []
            for i, value in enumerate(node):
                parts += ([F.lit(", ")] if i else []) + [piece(value)]
            return F.concat(F.lit("["), *parts, F.lit("]"))
        return F.lit(json.dumps(node))
    return piece(json.loads(template))
