"""Scoring operators over whole documents, turns and event properties."""
from __future__ import annotations

from pyspark.sql import functions as F

from proofmill.functions import text as X
from proofmill.operators import answers as A
from proofmill.operators.checks import against_threshold
from proofmill.operators.checks import fixed, judge, overlap, vectors
from proofmill.operators.checks.dispatch import Sides, score_checks
from proofmill.operators.rollup import count_checks, roll_up_runs, run_passed
from proofmill.sources.catalogue import check_types

from . import world
from .registry import query, view

NONE = "cast(map() as map<string,string>)"
RES = ["run_id", "label", "passed", "score", "detail", "errored"]


def _checks(df, config="", settings="", comparison=None):
    """The check contract around rows that have run_id, label, answer, reference."""
    def m(text):
        return F.expr(f"map({text})" if text else NONE)
    return (df.withColumn("config", m(config)).withColumn("engine_settings", m(settings))
            .withColumn("comparison", F.lit(comparison).cast("string")))


def _result_sql(table: str, error: str, passed: str, miss: str, score: str = "CAST(NULL AS DOUBLE)", pre: str = "") -> str:
    return f"""{pre} SELECT run_id, label, coalesce(e IS NULL AND p, false) AS passed, CASE WHEN e IS NULL THEN s END AS score,
  CASE WHEN e IS NOT NULL THEN e WHEN NOT coalesce(p, false) THEN m END AS detail, e IS NOT NULL AS errored
FROM (SELECT run_id, label, {error} AS e, {passed} AS p, {miss} AS m, {score} AS s FROM {table})"""


_WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_NWS = _WS.replace("[", "[^", 1)
_OLD = X.SPACES + X.SINGLE_QUOTES + X.DOUBLE_QUOTES + X.HYPHENS
_NEW = " " * len(X.SPACES) + "\'" * 2 * len(X.SINGLE_QUOTES) + '"' * len(X.DOUBLE_QUOTES) + "-" * len(X.HYPHENS)


def _look(c: str) -> str:
    return f"nfc_normalize(translate(regexp_replace({c}, '[{X.INVISIBLE}]', '', 'g'), '{_OLD}', '{_NEW}'))"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


@query("lookalikes_made_plain", f"SELECT doc_id, md5({_look('text')}) AS plain, length({_look('text')}) AS n FROM documents")
def lookalikes_made_plain(spark, sf):
    plain = X.normalize_lookalikes(F.col("text"))
    return (world.table(spark, sf, "documents").select("doc_id", plain.alias("p"))
            .select("doc_id", F.md5(F.col("p").cast("binary")).alias("plain"), F.length("p").cast("long").alias("n")))


view("copies", """SELECT d.doc_id AS run_id, 'copy' AS label, d.text AS answer, f.text AS reference FROM documents d
  LEFT JOIN (SELECT source, lang, min_by(text, doc_id) AS text FROM documents GROUP BY 1, 2) f ON f.source = d.source AND f.lang = d.lang""")


COPY_SHARES = 16


def _copies(spark, sf):
    d = world.table(spark, sf, "documents")
    # ids first, so that no grouping holds whole texts; each reference then stands
    # under several shares of its group, as a few groups own all documents
    ids = d.groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id"))
    first = d.join(ids, ["source", "lang", "doc_id"]).select("source", "lang", F.col("text").alias("reference")).dropDuplicates(["source", "lang"])
    first = first.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(COPY_SHARES - 1))))
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(COPY_SHARES)).cast("int")
    return d.withColumn("_share", share).join(first, ["source", "lang", "_share"], "left").select(
        F.col("doc_id").alias("run_id"), F.lit("copy").alias("label"), F.col("text").alias("answer"), "reference")


@query("exact_match_checks", _result_sql("copies", "CASE WHEN reference IS NULL THEN 'no_reference' END",
       f"{_strip(_look('answer'))} = {_strip(_look('reference'))}", "'differs'"), ["copies"])
def exact_match_checks(spark, sf):
    return fixed.check_exact(_checks(_copies(spark, sf))).select(*RES)


@query("exact_match_any_case", _result_sql("turns_c", "CASE WHEN reference IS NULL THEN 'no_reference' END",
       f"replace(lower({_strip('answer')}), 'ß', 'ss') = replace(lower({_strip('reference')}), 'ß', 'ss')", "'differs'",
       pre="WITH turns_c AS (SELECT conv_id || '-' || turn AS run_id, 'case' AS label, upper(coalesce(model_output, '')) AS answer, coalesce(expected_output, model_output) AS reference FROM turns)"), ["turns"])
def exact_match_any_case(spark, sf):
    t = world.turn_pairs(spark, sf).select(F.concat_ws("-", "conv_id", "turn").alias("run_id"), F.lit("case").alias("label"),
        F.upper(F.coalesce("model_output", F.lit(""))).alias("answer"), F.coalesce("expected_output", "model_output").alias("reference"))
    return fixed.check_exact(_checks(t), case_sensitive=False, lookalikes=False).select(*RES)


view("needles", """SELECT doc_id AS run_id, 'sub' AS label, text AS answer, CASE lang WHEN 'en' THEN 'the' WHEN 'fr' THEN 'EAU' WHEN 'de' THEN '' ELSE 'que' END AS needle FROM documents""")


def _needles(spark, sf):
    n = "'substring', CASE lang WHEN 'en' THEN 'the' WHEN 'fr' THEN 'EAU' WHEN 'de' THEN '' ELSE 'que' END"
    d = world.table(spark, sf, "documents").select(F.col("doc_id").alias("run_id"), F.lit("sub").alias("label"),
                                                   F.col("text").alias("answer"), F.lit(None).cast("string").alias("reference"), "lang")
    return _checks(d, n)


@query("contains_checks", _result_sql("needles", "CASE WHEN needle = '' THEN 'no_substring' END",
       f"contains({_look('answer')}, needle)", "'not_found'"), ["needles"])
def contains_checks(spark, sf):
    return fixed.check_contains(_needles(spark, sf)).select(*RES)


@query("does_not_contain_checks", _result_sql("needles", "CASE WHEN needle = '' THEN 'no_substring' END",
       "NOT contains(replace(lower(answer), 'ß', 'ss'), lower(needle))", "'forbidden_found'"), ["needles"])
def does_not_contain_checks(spark, sf):
    return fixed.check_contains(_needles(spark, sf), case_sensitive=False, negate=True, lookalikes=False).select(*RES)


_PAT = "CASE lang WHEN 'en' THEN '[A-Z][a-z]+ the [a-z]+' WHEN 'fr' THEN '(?i)EAU(x|s)' WHEN 'de' THEN elt(1 + run_id % 4, '(', '[z-a]', 'a{3,1}', '[a--z]') ELSE CASE WHEN run_id % 2 = 0 THEN '[a&&b]' ELSE '(?P<w>que) [a-z]+' END END"


def _patterned(spark, sf):
    d = world.table(spark, sf, "documents").select(F.col("doc_id").alias("run_id"), F.lit("re").alias("label"),
                                                   F.col("text").alias("answer"), F.lit(None).cast("string").alias("reference"), "lang")
    return _checks(d, f"'pattern', {_PAT}")


_PAT_OK = f"CASE WHEN lang = 'de' THEN NULL ELSE {{}}(text, CASE lang WHEN 'en' THEN '[A-Z][a-z]+ the [a-z]+' WHEN 'fr' THEN '(?i)EAU(x|s)' ELSE CASE WHEN run_id % 2 = 0 THEN '[a&&b]' ELSE '(?P<w>que) [a-z]+' END END) END"
_PT = "(SELECT doc_id AS run_id, 're' AS label, text, lang FROM documents)"


@query("regex_checks", _result_sql(_PT, "CASE WHEN lang = 'de' THEN 'invalid_pattern' END", _PAT_OK.format("regexp_matches"), "'no_match'"))
def regex_checks(spark, sf):
    return fixed.check_regex(_patterned(spark, sf), lookalikes=False).select(*RES)


@query("regex_must_not_match", _result_sql(_PT, "CASE WHEN lang = 'de' THEN 'invalid_pattern' END", "NOT " + _PAT_OK.format("regexp_full_match"), "'forbidden_match'"))
def regex_must_not_match(spark, sf):
    return fixed.check_regex(_patterned(spark, sf), mode="fullmatch", negate=True, lookalikes=False).select(*RES)


def _props(spark, sf, config=""):
    fenced = F.when(F.col("event_type") == "view", F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(
        F.col("event_type") == "error", F.concat(F.lit("Sure: "), "props")).otherwise(F.col("props"))
    e = world.table(spark, sf, "events").select(F.col("event_id").alias("run_id"), F.lit("json").alias("label"), fenced.alias("answer"),
                                                F.lit(None).cast("string").alias("reference"), "user_id", "event_type")
    return _checks(e, config)


view("props_c", """SELECT event_id AS run_id, 'json' AS label, props, user_id, event_type, event_type <> 'error' AS ok,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")


@query("json_validity_checks", _result_sql("props_c", "CAST(NULL AS VARCHAR)", "ok", "'not_json'"), ["props_c"])
def json_validity_checks(spark, sf):
    return fixed.check_json_valid(_props(spark, sf)).select(*RES)


@query("json_field_checks", _result_sql("props_c",
       "CASE WHEN ok AND event_type = 'click' THEN 'invalid_path' WHEN ok AND event_type = 'signup' AND user_id % 2 = 0 THEN 'value_not_json' END",
       "ok AND event_type <> 'purchase' AND k = user_id",
       "CASE WHEN NOT ok THEN 'not_json' WHEN event_type = 'purchase' THEN 'nothing_at_path' ELSE 'other_value' END"), ["props_c"])
def json_field_checks(spark, sf):
    config = ("'path', CASE event_type WHEN 'click' THEN '$..k' WHEN 'purchase' THEN 'missing' WHEN 'view' THEN 'k' ELSE '$.k' END, "
              "'value', CASE WHEN event_type = 'signup' AND user_id % 2 = 0 THEN '{' WHEN event_type = 'view' THEN concat(user_id, '.0') ELSE string(user_id) END")
    return fixed.check_json_field(_props(spark, sf, config)).select(*RES)


SMALL_K = '{"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 60}}, "additionalProperties": false}'
ODD_KEYWORD = '{"oneOf": []}'


@query("json_schema_checks", _result_sql("props_c", "CASE WHEN ok AND event_type = 'click' THEN 'unsupported_schema: keywords [''oneOf'']' END",
       "ok AND k BETWEEN 10 AND 60", "CASE WHEN NOT ok THEN 'not_json' ELSE 'schema_mismatch' END"), ["props_c"])
def json_schema_checks(spark, sf):
    df = _props(spark, sf, f"'schema', CASE WHEN event_type = 'click' THEN '{ODD_KEYWORD}' ELSE '{SMALL_K}' END")
    return fixed.check_json_schema(df, [SMALL_K, ODD_KEYWORD]).select(*RES)


@query("length_checks", _result_sql(
    f"(SELECT doc_id AS run_id, 'len' AS label, lang, len(regexp_extract_all(text, '{_NWS}+')) AS n FROM documents)",
    "CASE lang WHEN 'de' THEN 'max_not_number' WHEN 'es' THEN 'minimum_above_maximum' END", "n <= 300 AND (lang <> 'en' OR n >= 40)",
    "n || ' words' || CASE WHEN n > 300 THEN ' over' ELSE ' under' END"))
def length_checks(spark, sf):
    d = world.table(spark, sf, "documents").select(F.col("doc_id").alias("run_id"), F.lit("len").alias("label"),
                                                   F.col("text").alias("answer"), F.lit(None).cast("string").alias("reference"), "lang")
    config = ("'max', CASE lang WHEN 'de' THEN 'many' ELSE '300' END, 'min', CASE lang WHEN 'en' THEN '40' WHEN 'es' THEN '301' ELSE '' END")
    return fixed.check_length(_checks(d, config), "words").select(*RES)


@query("character_limits", _result_sql(f"(SELECT doc_id AS run_id, 'len' AS label, length({_strip('text')}) AS n FROM documents)",
       "CAST(NULL AS VARCHAR)", "n <= 1000", "n || ' characters over'"))
def character_limits(spark, sf):
    d = world.table(spark, sf, "documents").select(F.col("doc_id").alias("run_id"), F.lit("len").alias("label"),
                                                   F.col("text").alias("answer"), F.lit(None).cast("string").alias("reference"))
    return fixed.check_length(_checks(d, "'max', '1000'"), "characters").select(*RES)


@query("threshold_rule", """
SELECT run_id, label, coalesce(e IS NULL AND run_id % 7 > 0 AND CASE WHEN cmp = 'gte' THEN s >= 0.5 ELSE s <= 0.5 END, false) AS passed,
  CASE WHEN e IS NULL THEN s END AS score, CASE WHEN e IS NOT NULL THEN e
    WHEN run_id % 7 = 0 OR NOT CASE WHEN cmp = 'gte' THEN s >= 0.5 ELSE s <= 0.5 END THEN CASE WHEN cmp = 'gte' THEN 'below_threshold' ELSE 'above_threshold' END END AS detail,
  e IS NOT NULL AS errored
FROM (SELECT event_id AS run_id, 'score' AS label, round(value / 100, 4) AS s,
  CASE WHEN event_type = 'signup' THEN 'lte' WHEN event_type = 'error' THEN NULL ELSE 'gte' END AS cmp,
  CASE event_type WHEN 'view' THEN 'threshold_not_number' WHEN 'error' THEN 'no_comparison' WHEN 'click' THEN 'no_threshold' END AS e FROM events)""")
def threshold_rule(spark, sf):
    e = world.table(spark, sf, "events").select(
        F.col("event_id").alias("run_id"), F.lit("score").alias("label"), F.lit("").alias("answer"), F.lit("").alias("reference"),
        (F.col("value") / 100).alias("raw_score"), "event_type",
        F.expr("map('threshold', CASE WHEN event_type = 'view' THEN if(event_id % 2 = 0, 'high', '0.5d') WHEN event_type = 'click' THEN ' ' WHEN event_id % 7 = 0 THEN 'NaN' ELSE '0.5' END)").alias("config"),
        F.expr("CASE WHEN event_type = 'signup' THEN 'lte' WHEN event_type = 'error' THEN NULL ELSE 'gte' END").alias("comparison"))
    return against_threshold(e).select(*RES)


# ── wording metrics ──────────────────────────────────────────────────────────

def _gram_sql(n: int, tokens: str = "regexp_extract_all(lower(~C~), '[a-z0-9]+')") -> str:
    def side(c):
        t = tokens.replace("~C~", c)
        return (f"SELECT run_id, label, array_to_string(t[i:i+{n - 1}], ' ') AS g, count(*) AS c FROM (SELECT run_id, label, {t} AS t FROM pairs), "
                f"unnest(range(1, len(t) - {n} + 2)) u(i) GROUP BY 1, 2, 3")
    return f"""a{n} AS ({side('answer')}), r{n} AS ({side('reference')}),
sa{n} AS (SELECT run_id, label, sum(c)::DOUBLE AS na FROM a{n} GROUP BY 1, 2), sr{n} AS (SELECT run_id, label, sum(c)::DOUBLE AS nr FROM r{n} GROUP BY 1, 2),
sh{n} AS (SELECT run_id, label, sum(least(a.c, r.c))::DOUBLE AS hits FROM a{n} a JOIN r{n} r USING (run_id, label, g) GROUP BY 1, 2),
h{n} AS (SELECT run_id, label, coalesce(hits, 0) AS hits, coalesce(na, 0) AS na, coalesce(nr, 0) AS nr, reference IS NULL AS alone FROM pairs
  LEFT JOIN sh{n} USING (run_id, label) LEFT JOIN sa{n} USING (run_id, label) LEFT JOIN sr{n} USING (run_id, label))"""


for _n in (1, 2):
    def _register(n):
        @query(f"rouge_{n}_scores", f"""WITH {_gram_sql(n)}
SELECT run_id, label, round(CASE WHEN alone THEN NULL WHEN hits = 0 THEN 0.0 ELSE 2 * (hits / na) * (hits / nr) / (hits / na + hits / nr) END, 6) AS score FROM h{n}""", ["pairs"])
        def rouge_scores(spark, sf):
            return overlap.rouge_n(world.text_pairs(spark, sf), n).select("run_id", "label", F.round("raw_score", 6).alias("score"))
    _register(_n)


@query("rouge_l_scores")
def rouge_l_scores(spark, sf):
    return overlap.rouge_l(world.text_pairs(spark, sf), "f1", stemmer=True).select("run_id", "label", F.round("raw_score", 6).alias("score"))


@query("rouge_l_by_sentence")
def rouge_l_by_sentence(spark, sf):
    return overlap.rouge_lsum(world.text_pairs(spark, sf), "recall").select("run_id", "label", F.round("raw_score", 6).alias("score"))


_B1 = "(' ' || replace(replace(replace(replace(replace(replace(replace(~C~, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' ')"
_B2 = "regexp_replace(" + _B1 + r""", '([{|}~\[\\\]^_` !"#$%&()*+:;<=>?@/])', ' \1 ', 'g')"""
_B3 = rf"regexp_replace(regexp_replace(regexp_replace({_B2}, '([^0-9])([.,])', '\1 \2 ', 'g'), '([.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g')"
_BT = f"regexp_extract_all({_B3}, '{_NWS}+')"


@query("bleu_scores", f"""
WITH {', '.join(_gram_sql(n, _BT) for n in (1, 2, 3, 4))},
w AS (SELECT run_id, label, h1.hits AS c1, h2.hits AS c2, h3.hits AS c3, h4.hits AS c4, h1.na AS t1, h2.na AS t2, h3.na AS t3, h4.na AS t4, h1.nr AS r, h1.alone
  FROM h1 JOIN h2 USING (run_id, label) JOIN h3 USING (run_id, label) JOIN h4 USING (run_id, label)),
z AS (SELECT *, (c1 = 0)::INT AS z1, (c1 = 0)::INT + (c2 = 0)::INT AS z2, (c1 = 0)::INT + (c2 = 0)::INT + (c3 = 0)::INT AS z3,
  (c1 = 0)::INT + (c2 = 0)::INT + (c3 = 0)::INT + (c4 = 0)::INT AS z4 FROM w),
l AS (SELECT *, CASE WHEN t1 > 0 THEN ln(CASE WHEN c1 > 0 THEN 100 * c1 / t1 ELSE 100 / (pow(2, z1) * t1) END) ELSE 0 END
  + CASE WHEN t2 > 0 THEN ln(CASE WHEN c2 > 0 THEN 100 * c2 / t2 ELSE 100 / (pow(2, z2) * t2) END) ELSE 0 END
  + CASE WHEN t3 > 0 THEN ln(CASE WHEN c3 > 0 THEN 100 * c3 / t3 ELSE 100 / (pow(2, z3) * t3) END) ELSE 0 END
  + CASE WHEN t4 > 0 THEN ln(CASE WHEN c4 > 0 THEN 100 * c4 / t4 ELSE 100 / (pow(2, z4) * t4) END) ELSE 0 END AS logs,
  (t1 > 0)::INT + (t2 > 0)::INT + (t3 > 0)::INT + (t4 > 0)::INT AS used FROM z)
SELECT run_id, label, round(CASE WHEN alone THEN NULL WHEN c1 + c2 + c3 + c4 = 0 THEN 0.0 ELSE CASE WHEN t1 >= r THEN 1.0 ELSE exp(1 - r / t1) END * exp(logs / used) END, 6) AS score FROM l""",
       ["pairs"])
def bleu_scores(spark, sf):
    return overlap.bleu(world.text_pairs(spark, sf)).select("run_id", "label", F.round("raw_score", 6).alias("score"))


_MT = r"regexp_extract_all(lower(~C~), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\s]')"


@query("meteor_scores", f"""
WITH w AS (SELECT run_id, label, {_MT.replace("~C~", "answer")} AS ta, {_MT.replace("~C~", "reference")} AS tr FROM pairs),
a AS (SELECT run_id, i, t, row_number() OVER (PARTITION BY run_id, t ORDER BY i DESC) AS k FROM (SELECT run_id, unnest(ta) AS t, generate_subscripts(ta, 1) AS i FROM w)),
r AS (SELECT run_id, i, t, row_number() OVER (PARTITION BY run_id, t ORDER BY i DESC) AS k FROM (SELECT run_id, unnest(tr) AS t, generate_subscripts(tr, 1) AS i FROM w)),
m AS (SELECT run_id, a.i AS pa, r.i AS pr FROM a JOIN r USING (run_id, t, k)),
b AS (SELECT run_id, CASE WHEN pa - lag(pa) OVER o = 1 AND pr - lag(pr) OVER o = 1 THEN 0 ELSE 1 END AS br FROM m WINDOW o AS (PARTITION BY run_id ORDER BY pa)),
s AS (SELECT run_id, count(*)::DOUBLE AS m, sum(br)::DOUBLE AS c FROM b GROUP BY 1)
SELECT w.run_id, label, round(CASE WHEN tr IS NULL THEN NULL ELSE coalesce((m / len(ta)) * (m / len(tr)) / (0.9 * m / len(ta) + 0.1 * m / len(tr)) * (1 - 0.5 * pow(c / m, 3)), 0.0) END, 6) AS score
FROM w LEFT JOIN s USING (run_id)""", ["pairs"])
def meteor_scores(spark, sf):
    return overlap.meteor(world.text_pairs(spark, sf)).select("run_id", "label", F.round("raw_score", 6).alias("score"))


@query("meteor_with_stems")
def meteor_with_stems(spark, sf):
    return overlap.meteor(world.text_pairs(spark, sf), stemmer=True).select("run_id", "label", F.round("raw_score", 6).alias("score"))


# ── vectors ──────────────────────────────────────────────────────────────────

_COSINE_SQL = """
SELECT a.vec_id AS run_id, 'cos' AS label, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) /
  (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score
FROM embeddings a LEFT JOIN (SELECT vec_id, lead(vec_id) OVER (ORDER BY vec_id) AS after FROM embeddings) n USING (vec_id) LEFT JOIN embeddings b ON b.vec_id = n.after"""


@query("cosine_scores", _COSINE_SQL)
def cosine_scores(spark, sf):
    v = _vectors(spark, sf)
    checks = v.select("run_id", "label", F.lit("text").alias("answer"))
    return vectors.cosine_scores(checks, v).select("run_id", "label", F.round("raw_score", 6).alias("score"))


def _vectors(spark, sf):
    """Every vector against the one that follows it by id; the last has none."""
    e = world.table(spark, sf, "embeddings")
    return e.join(world.following(e, "vec_id"), "vec_id").select(F.col("vec_id").alias("run_id"), F.lit("cos").alias("label"), F.col("embedding").alias("answer_vector"), "_after").join(
        e.select(F.col("vec_id").alias("_after"), F.col("embedding").alias("reference_vector")), "_after", "left").drop("_after")


_TOKENS_SQL = """
WITH t AS (SELECT vec_id // 16 AS run_id, CASE WHEN vec_id % 16 < 8 THEN 'a' ELSE 'r' END AS side, vec_id AS pos, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT *, row_number() OVER (PARTITION BY run_id, side ORDER BY pos) AS i, count(*) OVER (PARTITION BY run_id, side) AS n FROM t),
s AS (SELECT a.run_id, a.i AS ai, a.n AS an, r.i AS ri, r.n AS rn, list_dot_product(a.v, r.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(r.v, r.v)) AS c
  FROM u a JOIN u r ON a.run_id = r.run_id AND a.side = 'a' AND r.side = 'r'),
p AS (SELECT run_id, avg(m) AS p FROM (SELECT run_id, ai, max(c) AS m FROM s WHERE ai > 1 AND ai < an AND an > 2 AND rn > 2 GROUP BY 1, 2) GROUP BY 1),
q AS (SELECT run_id, avg(m) AS r FROM (SELECT run_id, ri, max(c) AS m FROM s WHERE ri > 1 AND ri < rn AND an > 2 AND rn > 2 GROUP BY 1, 2) GROUP BY 1)
SELECT run_id, 'tok' AS label, round(coalesce(2 * p * r / (p + r), 0.0), 6) AS score FROM (SELECT DISTINCT run_id FROM t) LEFT JOIN p USING (run_id) LEFT JOIN q USING (run_id)"""


@query("token_vector_scores", _TOKENS_SQL)
def token_vector_scores(spark, sf):
    return vectors.token_vector_scores(_token_vectors(spark, sf)).select("run_id", "label", F.round("raw_score", 6).alias("score"))


def _token_vectors(spark, sf):
    pieces = world.table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 16).cast("long").alias("run_id"), F.lit("tok").alias("label"),
        F.when(F.col("vec_id") % 16 < 8, "answer").otherwise("reference").alias("side"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))
    return vectors.collect_token_vectors(pieces)


# ── judging ──────────────────────────────────────────────────────────────────

def _judged(spark, sf):
    d, l = world.table(spark, sf, "documents"), world.table(spark, sf, "labels")
    j = d.join(l, "doc_id", "left").select(F.col("doc_id").alias("run_id"), F.lit("judge").alias("label"), F.col("source").alias("input"),
        F.col("text").alias("answer"), F.when(F.col("lang") != "es", F.col("lang")).alias("reference"), "quality", "toxic", "lang")
    return _checks(j, "'rubric', CASE WHEN quality = 1 THEN ' Be kind. ' ELSE ' ' END",
                   "'default_rubric', CASE WHEN toxic = 1 THEN '' ELSE 'Be right.' END, 'reference', CASE WHEN lang = 'en' THEN 'false' ELSE 'true' END")


_RUB = """rub AS (SELECT d.doc_id AS run_id, CASE WHEN quality = 1 THEN 'Be kind.' WHEN coalesce(toxic, 0) = 1 THEN NULL ELSE 'Be right.' END AS rubric,
  CASE WHEN quality = 1 THEN 'custom' WHEN coalesce(toxic, 0) = 1 THEN NULL ELSE 'default' END AS rubric_source, d.* FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


@query("judge_rubrics", f"WITH {_RUB} SELECT run_id, rubric, rubric_source, rubric IS NULL AS errored FROM rub")
def judge_rubrics(spark, sf):
    return judge.resolve_rubric(_judged(spark, sf)).select("run_id", "rubric", "rubric_source", "errored")


@query("judge_prompts", f"""WITH {_RUB} SELECT run_id, rubric IS NULL OR lang = 'es' AS errored,
  CASE WHEN NOT (rubric IS NULL OR lang = 'es') THEN md5('<rubric>' || chr(10) || rubric || chr(10) || '</rubric>' || chr(10) || chr(10) || '<question>' || chr(10) || source || chr(10) || '</question>' || chr(10) || chr(10)
  || CASE WHEN lang <> 'en' THEN '<reference>' || chr(10) || lang || chr(10) || '</reference>' || chr(10) || chr(10) ELSE '' END
  || '<answer>' || chr(10) || text || chr(10) || '</answer>' || chr(10) || chr(10) || 'Say whether the answer passes the rubric.') END AS prompt FROM rub""")
def judge_prompts(spark, sf):
    out = judge.judge_prompts(judge.resolve_rubric(_judged(spark, sf)))
    return out.select("run_id", "errored", F.md5(F.col("prompt").cast("binary")).alias("prompt"))


@query("judge_replies", """
SELECT event_id AS run_id, CASE WHEN event_type IN ('click', 'view') THEN user_id % 2 = 0 ELSE false END AS passed,
  CASE WHEN event_type IN ('click', 'view') THEN 'k ' || json_extract_string(props, '$.k') END AS rationale,
  CASE WHEN event_type IN ('error', 'purchase') THEN NULL ELSE user_id END AS input_tokens,
  CASE event_type WHEN 'click' THEN NULL WHEN 'error' THEN NULL WHEN 'purchase' THEN NULL ELSE event_id END AS output_tokens,
  event_type NOT IN ('click', 'view') AS errored,
  CASE event_type WHEN 'error' THEN 'unreadable' WHEN 'purchase' THEN 'refused' WHEN 'signup' THEN 'passed_not_boolean' END AS detail FROM events""")
def judge_replies(spark, sf):
    e = world.table(spark, sf, "events")
    said = F.concat(F.lit("k "), F.get_json_object("props", "$.k"))
    flag = F.when(F.col("user_id") % 2 == 0, "true").otherwise("false")
    body = (F.when(F.col("event_type") == "click", F.format_string(
        '{"content": [{"type": "text", "text": "x"}, {"type": "tool_use", "input": {"passed": %s, "rationale": "%s"}}], "usage": {"input_tokens": %d}}', flag, said, F.col("user_id")))
        .when(F.col("event_type") == "view", F.format_string(
            '{"choices": [{"message": {"content": "{\\"passed\\": %s, \\"rationale\\": \\"%s\\"}"}}], "usage": {"prompt_tokens": %d, "completion_tokens": %d}}', flag, said, F.col("user_id"), F.col("event_id")))
        .when(F.col("event_type") == "signup", F.format_string(
            '{"content": [{"type": "tool_use", "input": {"passed": "yes", "rationale": "%s"}}], "usage": {"input_tokens": %d, "output_tokens": %d}}', said, F.col("user_id"), F.col("event_id")))
        .when(F.col("event_type") == "purchase", F.lit('{"stop_reason": "refusal", "content": []}')).otherwise("not json"))
    out = judge.parse_judge_replies(e.select(F.col("event_id").alias("run_id"), body.alias("body")))
    return out.select("run_id", "passed", "rationale", "input_tokens", "output_tokens", "errored", "detail")


# ── answers, dispatch, roll-up ───────────────────────────────────────────────

def _answered(spark, sf):
    """Turns as runs; replies stand in events with the same number."""
    e = world.table(spark, sf, "events")
    runs = e.select(F.col("event_id").alias("run_id"), F.lit("Running").alias("status"),
                    F.when(F.col("event_type") == "click", F.concat(F.lit('{"n": '), F.col("user_id").cast("string"), F.lit("}"))).alias("model_output"))
    replies = e.filter("event_type <> 'error'").select(F.col("event_id").alias("run_id"),
        F.when(F.col("event_type") == "signup", "<html>").otherwise(F.col("props")).alias("reply"))
    return A.resolve_answer(runs, replies, "$.k")


view("answered", """SELECT event_id AS run_id, event_type, user_id, props,
  CASE event_type WHEN 'click' THEN '{"n": ' || user_id || '}' WHEN 'error' THEN NULL WHEN 'signup' THEN NULL ELSE json_extract_string(props, '$.k') END AS answer,
  CASE event_type WHEN 'click' THEN 'recorded' WHEN 'error' THEN NULL WHEN 'signup' THEN NULL ELSE 'application' END AS output_source,
  CASE event_type WHEN 'error' THEN 'no_reply' WHEN 'signup' THEN 'reply_not_json' END AS no_answer FROM events""")


@query("resolved_answers", "SELECT run_id, answer, output_source, no_answer FROM answered", ["answered"])
def resolved_answers(spark, sf):
    return _answered(spark, sf).select("run_id", "answer", "output_source", "no_answer")


@query("runs_without_answer", """SELECT run_id, CASE WHEN answer IS NULL THEN 'NotRan' ELSE 'Running' END AS status, no_answer AS error FROM answered""", ["answered"])
def runs_without_answer(spark, sf):
    return A.mark_not_ran(_answered(spark, sf)).select("run_id", "status", "error")


@query("answers_at_paths", """SELECT event_id, props.k AS k, CASE event_type WHEN 'error' THEN NULL ELSE props.k END AS at_path
FROM (SELECT event_id, event_type, {'k': json_extract_string(props, '$.k')} AS props FROM events)""")
def answers_at_paths(spark, sf):
    e = world.table(spark, sf, "events")
    return e.select("event_id", A.answer_at(F.col("props"), F.lit("k")).alias("k"),
                    A.answer_at(F.col("props"), F.when(F.col("event_type") == "error", "$.gone[0]").otherwise("$['k']")).alias("at_path"))


@query("answers_for_checks", """SELECT run_id, label, CASE WHEN label = 'all' THEN answer WHEN output_source = 'application' THEN json_extract_string(props, '$.k') WHEN output_source = 'recorded' THEN NULL END AS answer,
  CASE WHEN label = 'all' THEN NULL WHEN output_source = 'recorded' THEN 'nothing_at_path' WHEN output_source IS NULL THEN 'not_json' END AS detail
FROM answered, (VALUES ('all'), ('part')) t(label)""", ["answered"])
def answers_for_checks(spark, sf):
    checks = _answered(spark, sf).withColumn("label", F.explode(F.array(F.lit("all"), F.lit("part")))).withColumn(
        "answer_path", F.when(F.col("label") == "part", "$.k"))
    return A.answer_for_check(checks).select("run_id", "label", "answer", "detail")


@query("request_bodies", """SELECT conv_id, turn, md5('{"model": "m", "messages": [{"role": "user", "content": ' || to_json('Q: ' || input) || '}], "n": 1}') AS body FROM turns""", ["turns"])
def request_bodies(spark, sf):
    body = A.render_body('{"model": "m", "messages": [{"role": "user", "content": "Q: {{input}}"}], "n": 1}', F.col("input"))
    return world.turn_pairs(spark, sf).select("conv_id", "turn", F.md5(body.cast("binary")).alias("body"))


def _mixed(spark, sf):
    """Every document under five checks, one of an unknown type."""
    d = world.table(spark, sf, "documents")
    one = lambda label, kind, config: F.struct(F.lit(label).alias("label"), F.lit(kind).alias("test_type"), F.expr(config).alias("config"))
    checks = F.array(one("has the", "Contains", "map('substring', 'the')"), one("no digits", "Regex Must Not Match", "map('pattern', '[0-9]+')"),
                     one("json", "Is Valid JSON", NONE), one("short", "Word Count Limit", "map('max', '200')"), one("odd", "Mind Reading", NONE))
    return d.select(F.col("doc_id").alias("run_id"), F.col("text").alias("answer"), F.lit(None).cast("string").alias("reference"),
                    F.explode(checks).alias("c")).select("run_id", "answer", "reference", "c.*")


view("mixed", f"""
SELECT doc_id AS run_id, t.label, CASE t.label WHEN 'has the' THEN contains(text, 'the') WHEN 'no digits' THEN NOT regexp_matches(text, '[0-9]') WHEN 'json' THEN false
  WHEN 'short' THEN len(regexp_extract_all(text, '{_NWS}+')) <= 200 ELSE false END AS passed, t.label = 'odd' AS errored
FROM documents, (VALUES ('has the'), ('no digits'), ('json'), ('short'), ('odd')) t(label)""")


@query("scored_checks", "SELECT run_id, label, passed, errored FROM mixed", ["mixed"])
def scored_checks(spark, sf):
    return score_checks(_mixed(spark, sf), check_types(spark), metrics=()).select("run_id", "label", "passed", "errored")


@query("scored_wording_checks")
def scored_wording_checks(spark, sf):
    p = world.text_pairs(spark, sf).withColumn("config", F.expr("map('threshold', '0.3')"))
    kinds = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(k).alias("test_type")) for k in ("ROUGE-1", "ROUGE", "BLEU")])
    checks = p.drop("label").withColumn("c", F.explode(kinds)).select("run_id", "answer", "reference", "config", "c.*")
    return score_checks(checks, check_types(spark), metrics=("rouge", "bleu"))


def _results(spark, sf):
    return score_checks(_mixed(spark, sf), check_types(spark), metrics=())


@query("run_outcomes", """SELECT run_id, CASE WHEN bool_and(passed AND NOT errored) THEN 'Green' WHEN bool_or(passed AND NOT errored) THEN 'Amber' ELSE 'Red' END AS status
FROM mixed GROUP BY 1""", ["mixed"])
def run_outcomes(spark, sf):
    return roll_up_runs(_results(spark, sf))


@query("run_check_counts", """SELECT run_id, count(*) FILTER (WHERE passed AND NOT errored) AS met, count(*) AS total,
  string_agg(label, '|' ORDER BY lower(label)) FILTER (WHERE NOT (passed AND NOT errored)) AS unmet FROM mixed GROUP BY 1""", ["mixed"])
def run_check_counts(spark, sf):
    return count_checks(_results(spark, sf)).withColumn("unmet", F.array_join("unmet", "|"))


@query("run_passed_decided", "SELECT run_id, bool_and(passed) FILTER (WHERE NOT errored) AS run_passed FROM mixed GROUP BY 1", ["mixed"])
def run_passed_decided(spark, sf):
    return run_passed(_results(spark, sf), ["run_id"])


_ENGINES = [("has the", "Contains", "map('substring', 'the')"), ("short", "Word Count Limit", "map('max', '200')"), ("cos", "Cosine Similarity", "map('threshold', '0.1')"),
            ("tok", "BERTScore", "map('threshold', '0.3')"), ("judge", "Toxicity", "map('rubric', 'Be kind.')"), ("right", "Correctness", "map('rubric', 'Be right.')"),
            ("blank", "Bias", "map('rubric', ' ')"), ("odd", "Mind Reading", "map('x', 'y')")]


@query("every_engine_scored", f"""
WITH cos AS ({_COSINE_SQL.replace("round(", "(").replace(", 6)", ")")}), tok AS ({_TOKENS_SQL.replace("round(", "(").replace(", 6)", ")")}),
c AS (SELECT d.*, t.label FROM documents d, (VALUES {", ".join(f"('{x[0]}')" for x in _ENGINES)}) t(label)),
s AS (SELECT c.*, round(coalesce(cos.score, tok.score), 4) AS score, quality, toxic, CASE
    WHEN c.label IN ('cos', 'tok') AND lang = 'es' THEN 'no_reference' WHEN c.label = 'cos' AND cos.score IS NULL THEN 'no_vectors' WHEN c.label = 'tok' AND tok.score IS NULL THEN 'no_vectors'
    WHEN c.label = 'blank' THEN 'no_rubric' WHEN c.label = 'right' AND lang = 'es' THEN 'no_reference' WHEN c.label IN ('judge', 'right') AND l.doc_id IS NULL THEN 'no_reply'
    WHEN c.label = 'right' AND toxic = 1 THEN 'unreadable' WHEN c.label = 'odd' THEN 'unknown_type' END AS bad
  FROM c LEFT JOIN cos ON c.label = 'cos' AND cos.run_id = doc_id LEFT JOIN tok ON c.label = 'tok' AND tok.run_id = doc_id LEFT JOIN labels l USING (doc_id))
SELECT doc_id AS run_id, label, bad IS NOT NULL AS errored, bad AS reason, CASE WHEN bad IS NULL THEN score END AS score, coalesce(bad IS NULL AND CASE label
  WHEN 'has the' THEN contains(text, 'the') WHEN 'short' THEN len(regexp_extract_all(text, '{_NWS}+')) <= 200 WHEN 'cos' THEN score >= 0.1 WHEN 'tok' THEN score >= 0.3
  ELSE quality = 1 END, false) AS passed FROM s""")
def every_engine_scored(spark, sf):
    """Fixed, vector, token-vector and judge checks of every document in one pass."""
    d = world.table(spark, sf, "documents")
    checks = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(k).alias("test_type"), F.expr(c).alias("config")) for n, k, c in _ENGINES])
    rows = d.select(F.col("doc_id").alias("run_id"), F.col("text").alias("answer"), F.when(F.col("lang") != "es", F.col("lang")).alias("reference"), F.explode(checks).alias("c"))
    said = F.format_string('{"content": [{"type": "tool_use", "input": {"passed": %s, "rationale": "r"}}]}', F.when(F.col("quality") == 1, "true").otherwise("false"))
    labels = F.explode(F.array(F.lit("judge"), F.lit("right"), F.lit("blank"))).alias("label")
    replies = world.table(spark, sf, "labels").select(F.col("doc_id").alias("run_id"), labels, said.alias("body"), "toxic").withColumn(
        "body", F.when((F.col("label") == "right") & (F.col("toxic") == 1), "{").otherwise(F.col("body")))
    sides = Sides(vectors=_vectors(spark, sf), token_vectors=_token_vectors(spark, sf), replies=replies)
    out = score_checks(rows.select("run_id", "answer", "reference", "c.*"), check_types(spark), metrics=(), sides=sides)
    return out.select("run_id", "label", "errored", F.when(F.col("errored"), F.col("detail")).alias("reason"), "score", "passed")
