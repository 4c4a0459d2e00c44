"""Ingest, datasets, tests, snapshots and fan-out over the shared tables."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from proofmill.functions import text as X
from proofmill.operators import authoring as A
from proofmill.operators import fanout as O
from proofmill.session import shared_folder
from proofmill.sources import catalogue, lines, tables

from . import world
from .registry import query, view

# ── ingest ───────────────────────────────────────────────────────────────────

def _lines(spark, sf):
    """Documents as JSON lines, some broken by language."""
    d = world.table(spark, sf, "documents")
    good = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("lang").alias("expected_output"), F.col("source").alias("model_output")))
    value = (F.when(F.col("lang") == "de", F.concat(F.lit('{"prompt": 5, "model_output": "'), "source", F.lit('"}')))
             .when(F.col("lang") == "es", F.when(F.col("n_chars") > 1000, "[1, 2]").otherwise("not json"))
             .when((F.col("lang") == "fr") & (F.col("n_chars") > 1000), F.lit(" ")).otherwise(good))
    return d.select(F.col("doc_id").alias("line"), value.alias("value"))


view("lined", """SELECT doc_id AS line, lang, text, source, CASE WHEN lang = 'de' THEN 'prompt:not_text|expected_output:missing'
  WHEN lang = 'es' THEN CASE WHEN n_chars > 1000 THEN 'not_an_object' ELSE 'not_json' END WHEN lang = 'fr' AND n_chars > 1000 THEN 'not_json' END AS problems FROM documents""")


@query("invalid_lines", "SELECT line, problems FROM lined WHERE problems IS NOT NULL", ["lined"])
def invalid_lines(spark, sf):
    return lines.validate_rows(_lines(spark, sf))[1].select("line", F.array_join("problems", "|").alias("problems"))


@query("valid_lines", "SELECT line, md5(text) AS input, lang AS expected_output, source AS model_output FROM lined WHERE problems IS NULL", ["lined"])
def valid_lines(spark, sf):
    return lines.validate_rows(_lines(spark, sf))[0].select("line", F.md5(F.col("input").cast("binary")).alias("input"), "expected_output", "model_output")


@query("import_report", "SELECT count(*) AS invalid_lines, count(*) = 0 AS accepted FROM lined WHERE problems IS NOT NULL", ["lined"])
def import_report(spark, sf):
    return lines.import_report(lines.validate_rows(_lines(spark, sf))[1])[0]


@query("first_invalid_lines", "SELECT line, problems FROM lined WHERE problems IS NOT NULL ORDER BY line LIMIT 100", ["lined"])
def first_invalid_lines(spark, sf):
    return lines.import_report(lines.validate_rows(_lines(spark, sf))[1])[1].select("line", F.array_join("problems", "|").alias("problems"))


@query("read_back_lines", """SELECT CASE WHEN lang = 'fr' AND problems IS NOT NULL THEN 'blank' ELSE coalesce(problems, 'fine') END AS outcome, count(*) AS lines
FROM lined WHERE NOT (lang = 'fr' AND problems IS NOT NULL) GROUP BY 1""", ["lined"])
def read_back_lines(spark, sf):
    """Written as text files, read, numbered and validated; blank lines go."""
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    _lines(spark, sf).select("value").write.text(folder)
    good, bad = lines.validate_rows(lines.read_eval_jsonl(spark, folder))
    outcome = good.select(F.lit("fine").alias("outcome")).unionByName(bad.select(F.array_join("problems", "|").alias("outcome")))
    return outcome.groupBy("outcome").agg(F.count(F.lit(1)).alias("lines"))


@query("saved_results", """SELECT batch_id, label, count(*) AS results, count(*) FILTER (WHERE passed) AS passed FROM results GROUP BY 1, 2""", ["results"])
def saved_results(spark, sf):
    """Check results written by batch and read back with the declared schema."""
    folder = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    df = world.timed_results(spark, sf).withColumn("batch_index", F.col("batch_index").cast("int")).withColumn("entry_id", F.col("entry_id").cast("string"))
    full = df.withColumn("test_type", F.lit(None).cast("string")).withColumn("engine", F.lit(None).cast("string"))
    tables.save(full, folder, "check_results")
    return tables.load(spark, folder, "check_results").groupBy("batch_id", "label").agg(
        F.count(F.lit(1)).alias("results"), F.count_if("passed").alias("passed"))


_BAD_TESTS_SQL = """
SELECT 'mean ' || s_suppkey AS id, problem FROM supplier, (VALUES ('parameters'), ('unknown_setting:colour'), ('setting_value:floor'), ('missing_setting:recommended_times')) t(problem) WHERE s_acctbal < 0
UNION ALL SELECT 'gate ' || s_suppkey, 'default:target' FROM supplier WHERE s_acctbal > 9000
UNION ALL SELECT 'odd ' || s_suppkey, 'unknown_engine' FROM supplier WHERE s_acctbal BETWEEN 0 AND 1000"""


@query("catalogue_problems", _BAD_TESTS_SQL)
def catalogue_problems(spark, sf):
    """The built-in tests have none; one made per supplier has those its balance says."""
    s = world.table(spark, sf, "supplier")
    p = lambda key, kind, default, low, high: f"named_struct('key','{key}','kind','{kind}','default',{default}D,'min',{low}D,'max',{high}D)"
    level, rate = p("confidence", "level", 0.95, 0.8, 0.999), p("target", "rate", 0.9, 0.5, 0.999)
    low = s.filter("s_acctbal < 0").select(F.expr("concat('mean ', s_suppkey)").alias("id"), F.lit("one_sample_t").alias("engine"),
        F.expr(f"array({level})").alias("parameters"), F.expr("map('floor', '1', 'colour', '4')").alias("engine_settings"))
    high = s.filter("s_acctbal > 9000").select(F.expr("concat('gate ', s_suppkey)").alias("id"), F.lit("binomial_gate").alias("engine"),
        F.expr(f"array({level}, {rate.replace('0.9D', '0.4D', 1)})").alias("parameters"), F.expr("cast(map() as map<string,string>)").alias("engine_settings"))
    odd = s.filter("s_acctbal between 0 and 1000").select(F.expr("concat('odd ', s_suppkey)").alias("id"), F.lit("crystal_ball").alias("engine"),
        F.expr(f"array({level})").alias("parameters"), F.expr("cast(map() as map<string,string>)").alias("engine_settings"))
    rows = low.unionByName(high).unionByName(odd).unionByName(catalogue.stat_tests(spark))
    return catalogue.validate_catalogue(rows, catalogue.engine_specs(spark))


@query("assigned_check_types", """SELECT t.test_type AS name, CASE t.test_type WHEN 'Exact Match' THEN 'deterministic' WHEN 'ROUGE' THEN 'nlp_metric' ELSE 'llm_as_judge' END AS category, count(*) AS entries
FROM entries CROSS JOIN labels3 t WHERE t.test_type <> 'Correctness' GROUP BY 1, 2""", ["entries", "labels3"])
def assigned_check_types(spark, sf):
    """Check types of two categories with the entries that use each."""
    used = world.entries(spark, sf).select(F.explode("assignments.name").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("entries"))
    types = catalogue.check_types(spark)
    picked = catalogue.check_types_by_category(types, "deterministic").unionByName(catalogue.check_types_by_category(types, "nlp_metric"))
    return used.join(picked.select("name", "category"), "name")


# ── dataset rows ─────────────────────────────────────────────────────────────

def _new_rows(spark, sf):
    t = world.turn_pairs(spark, sf)
    return t.select(F.expr("concat(conv_id, '-', turn)").alias("id"), F.expr("concat('src', pmod(conv_id, 25))").alias("dataset_id"),
                    (F.col("conv_id") * 100 + F.col("turn")).alias("ord"), "input", "expected_output", "model_output")


def _text_rows(spark, sf):
    return world.dataset_rows(spark, sf).withColumn("id", F.col("id").cast("string"))


@query("appended_rows", """
WITH n AS (SELECT conv_id || '-' || turn AS id, 'src' || (conv_id % 25) AS dataset_id, row_number() OVER (PARTITION BY conv_id % 25 ORDER BY conv_id, turn) AS k FROM turns),
h AS (SELECT dataset_id, max(position) AS top FROM drows GROUP BY 1)
SELECT CAST(id AS VARCHAR) AS id, dataset_id, position FROM drows UNION ALL SELECT id, dataset_id, CAST(coalesce(top, 0) + k AS INTEGER) FROM n LEFT JOIN h USING (dataset_id)""", ["turns", "drows"])
def appended_rows(spark, sf):
    return A.append_rows(_text_rows(spark, sf), _new_rows(spark, sf)).select("id", "dataset_id", "position")


@query("replaced_rows", """
SELECT CAST(id AS VARCHAR) AS id, dataset_id, position FROM drows WHERE dataset_id <> 'src3'
UNION ALL SELECT conv_id || '-' || turn, 'src3', CAST(row_number() OVER (ORDER BY conv_id, turn) AS INTEGER) FROM turns""", ["turns", "drows"])
def replaced_rows(spark, sf):
    return A.replace_rows(_text_rows(spark, sf), "src3", _new_rows(spark, sf)).select("id", "dataset_id", "position")


def _changes(spark, sf):
    l = world.table(spark, sf, "labels")
    return l.select(F.when(F.col("toxic") == 1, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id")).cast("string").alias("id"),
                    F.concat(F.lit("q"), F.col("quality").cast("string")).alias("input"), F.lit(None).cast("string").alias("expected_output"), F.lit("new").alias("model_output"))


@query("updated_rows", """SELECT CAST(d.id AS VARCHAR) AS id, CASE WHEN l.toxic = 0 THEN 'q' || l.quality ELSE md5(d.input) END AS input, d.expected_output,
  CASE WHEN l.toxic = 0 THEN 'new' ELSE md5(d.model_output) END AS model_output FROM drows d LEFT JOIN labels l ON l.doc_id = d.id""", ["drows"])
def updated_rows(spark, sf):
    out = A.upsert_rows(_text_rows(spark, sf), _changes(spark, sf))[0]
    h = lambda c: F.when(F.col(c).rlike("^(q[01]|new)$"), F.col(c)).otherwise(F.md5(F.col(c).cast("binary"))).alias(c)
    return out.select("id", h("input"), "expected_output", h("model_output"))


@query("unknown_row_ids", "SELECT CAST(doc_id + 1000000000 AS VARCHAR) AS id FROM labels WHERE toxic = 1")
def unknown_row_ids(spark, sf):
    return A.upsert_rows(_text_rows(spark, sf), _changes(spark, sf))[1]


def _made_tests(spark, sf):
    """Tests made from part of the rows: those with labels."""
    l = world.table(spark, sf, "labels")
    return l.select(F.expr("concat('t', doc_id)").alias("test_id"), F.col("doc_id").cast("string").alias("dataset_row_id"), F.col("quality").alias("q"))


@query("rows_after_delete", "SELECT CAST(id AS VARCHAR) AS id FROM drows WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)", ["drows"])
def rows_after_delete(spark, sf):
    ids = world.table(spark, sf, "labels").filter("quality = 0").select(F.col("doc_id").cast("string").alias("id"))
    return A.delete_rows(_text_rows(spark, sf), _made_tests(spark, sf), ids)[0].select("id")


@query("tests_after_delete", "SELECT 't' || doc_id AS test_id, CASE WHEN quality = 1 THEN CAST(doc_id AS VARCHAR) END AS dataset_row_id FROM labels")
def tests_after_delete(spark, sf):
    ids = world.table(spark, sf, "labels").filter("quality = 0").select(F.col("doc_id").cast("string").alias("id"))
    return A.delete_rows(_text_rows(spark, sf), _made_tests(spark, sf), ids)[1].select("test_id", "dataset_row_id")


@query("described_datasets", """SELECT u.id, count(d.id) AS rows, md5(min_by(d.input, d.position)) AS first_prompt
FROM (SELECT source AS id FROM documents WHERE source IS NOT NULL UNION SELECT 'src' || n_nationkey FROM nation) u LEFT JOIN drows d ON d.dataset_id = u.id GROUP BY 1""", ["drows"])
def described_datasets(spark, sf):
    named = world.table(spark, sf, "documents").filter("source is not null").select(F.col("source").alias("id"))
    sets = named.union(world.table(spark, sf, "nation").select(F.concat(F.lit("src"), "n_nationkey"))).distinct()
    return A.describe_datasets(sets, world.dataset_rows(spark, sf)).select("id", "rows", F.md5(F.col("first_prompt").cast("binary")).alias("first_prompt"))


@query("described_rows", "SELECT CAST(id AS VARCHAR) AS id, position, (SELECT count(*) FROM labels WHERE doc_id = id) AS tests FROM drows", ["drows"])
def described_rows(spark, sf):
    return A.describe_rows(_text_rows(spark, sf), _made_tests(spark, sf)).select("id", "position", "tests")


# ── tests ────────────────────────────────────────────────────────────────────

CHECKS = [{"name": "Exact Match", "label": "same"}, {"name": "Contains", "label": "has", "config": {"substring": "x"}}]
_NAME = r"""CASE WHEN length(s) <= 60 THEN s ELSE rtrim(CASE WHEN s[60] = ' ' THEN s[1:59] WHEN NOT contains(s[1:59], ' ') THEN s[1:59]
  ELSE regexp_extract(s[1:59], '^(.*) [^ ]*$', 1) END) || '…' END"""
_WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


@query("tests_from_rows", f"""
SELECT CAST(id AS VARCHAR) AS dataset_row_id, {_NAME} AS name, model_output IS NOT NULL AS recorded
FROM (SELECT *, regexp_replace(regexp_replace(input, '^{_WS}|{_WS}$', '', 'g'), '{_WS}', ' ', 'g') AS s FROM drows)""", ["drows"])
def tests_from_rows(spark, sf):
    tests, _ = A.tests_from_rows(_text_rows(spark, sf), CHECKS)
    return tests.select("dataset_row_id", "name", F.col("model_output").isNotNull().alias("recorded"))


@query("assignments_from_rows", "SELECT id, label, name FROM drows, (VALUES ('same', 'Exact Match'), ('has', 'Contains')) t(label, name)", ["drows"])
def assignments_from_rows(spark, sf):
    tests, each = A.tests_from_rows(world.dataset_rows(spark, sf), CHECKS)
    return each.join(tests.select("test_id", F.col("dataset_row_id").alias("id")), "test_id").select("id", "label", "name")


@query("foreign_row_ids", "SELECT id FROM drows WHERE dataset_id <> 'src1'", ["drows"])
def foreign_row_ids(spark, sf):
    rows = world.dataset_rows(spark, sf)
    return A.foreign_rows(rows, rows, "src1")


@query("recorded_answers", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN NULL ELSE props END AS answer FROM events")
def recorded_answers(spark, sf):
    e = world.table(spark, sf, "events")
    raw = F.when(F.col("event_type") == "click", " \t\n ").when(F.col("event_type") == "view", " ").otherwise(F.col("props"))
    return e.select("event_id", X.recorded_answer(raw).alias("answer"))


@query("names_from_prompts", f"""SELECT conv_id, turn, {_NAME} AS name FROM (SELECT *, regexp_replace(regexp_replace(text, '^{_WS}|{_WS}$', '', 'g'), '{_WS}', ' ', 'g') AS s FROM conversations)""")
def names_from_prompts(spark, sf):
    return world.table(spark, sf, "conversations").select("conv_id", "turn", X.name_from_prompt(F.col("text")).alias("name"))


@query("numbered_names", """
WITH e AS (SELECT max(l_partkey) FILTER (WHERE l_linenumber < 4) AS top FROM lineitem)
SELECT c_custkey AS id, 'New Test ' || (coalesce(top, 0) + row_number() OVER (ORDER BY c_custkey)) AS name FROM customer, e""")
def numbered_names(spark, sf):
    li = world.table(spark, sf, "lineitem")
    existing = li.select(F.when(F.col("l_linenumber") < 4, F.expr("concat('New Test ', l_partkey)")).otherwise(F.expr("concat('New Test x', l_partkey)")).alias("name"))
    return A.number_names(existing, world.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "id").select("id", "name")


def _to_label(spark, sf):
    """Order lines as assignments of an order: part size names the type; some
    come with a label, which may look like a numbered one."""
    li, p = world.table(spark, sf, "lineitem"), world.table(spark, sf, "part")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    pos = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey"))
    kind = F.when(F.col("p_size") > 25, "Contains").otherwise("BLEU")
    return j.select(F.col("l_orderkey").alias("test_id"), pos.alias("pos"), kind.alias("name"), F.lit(None).cast("string").alias("label"), "l_returnflag")


view("tolabel", """SELECT l_orderkey AS test_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_suppkey) AS pos,
  CASE WHEN p_size > 25 THEN 'Contains' ELSE 'BLEU' END AS name, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey""")


@query("default_labels", """
WITH x AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY pos) = 1 AND l_returnflag = 'R' AS sent FROM tolabel),
t AS (SELECT test_id, name AS k FROM x WHERE sent),
y AS (SELECT x.*, row_number() OVER (PARTITION BY x.test_id, x.name ORDER BY pos) AS k FROM x WHERE NOT sent)
SELECT test_id, pos, CASE WHEN sent THEN lower(name) || ' 2' ELSE NULL END AS label FROM x WHERE sent
UNION ALL SELECT y.test_id, y.pos, CASE WHEN y.k = 1 THEN y.name WHEN t.k IS NOT NULL THEN y.name || ' ' || (y.k + 1) ELSE y.name || ' ' || y.k END
FROM y LEFT JOIN t ON t.test_id = y.test_id AND t.k = y.name""", ["tolabel"])
def default_labels(spark, sf):
    # the first assignment of a test, when returned, was sent labelled "<type> 2" in small letters
    rows = _to_label(spark, sf).withColumn("label", F.when((F.col("pos") == 1) & (F.col("l_returnflag") == "R"), F.concat(F.lower("name"), F.lit(" 2"))))
    return A.label_assignments(rows).select("test_id", F.col("pos").cast("long").alias("pos"), "label")


@query("checks_in_label_order", "SELECT entry_id, string_agg(label, '|' ORDER BY lower(label)) AS labels FROM entries CROSS JOIN labels3 GROUP BY 1", ["entries", "labels3"])
def checks_in_label_order(spark, sf):
    frozen = O.freeze(*_tests(spark, sf))
    return frozen.select(F.col("test_id").alias("entry_id"), F.array_join(F.transform("assignments", lambda a: a["label"]), "|").alias("labels"))


def _sent(spark, sf):
    """Assignments out of events: the type and its settings come with the event."""
    e = world.table(spark, sf, "events")
    name = F.expr("CASE event_type WHEN 'click' THEN 'Contains' WHEN 'view' THEN 'Word Count Limit' WHEN 'error' THEN 'Guess' WHEN 'signup' THEN 'BLEU' ELSE 'ROUGE' END")
    config = F.expr("CASE event_type WHEN 'click' THEN map('substring', '') WHEN 'view' THEN map('max', string(value / 4)) WHEN 'signup' THEN map('threshold', string(value)) ELSE map('threshold', 'high') END")
    return e.select(F.col("user_id").alias("test_id"), F.expr("concat(IF(event_type = 'error', 'L', 'l'), pmod(event_id, 40))").alias("label"), name.alias("name"), config.alias("config"))


@query("assignment_problems", """
WITH s AS (SELECT user_id AS test_id, CASE WHEN event_type = 'error' THEN 'L' ELSE 'l' END || (event_id % 40) AS label,
  CASE event_type WHEN 'click' THEN 'Contains' WHEN 'view' THEN 'Word Count Limit' WHEN 'error' THEN 'Guess' WHEN 'signup' THEN 'BLEU' ELSE 'ROUGE' END AS name, value FROM events)
SELECT test_id, label, name, 'unknown_type' AS problem FROM s WHERE name = 'Guess'
UNION ALL SELECT test_id, label, name, 'substring:missing' FROM s WHERE name = 'Contains'
UNION ALL SELECT test_id, label, name, 'max:not_whole' FROM s WHERE name = 'Word Count Limit' AND value / 4 <> floor(value / 4)
UNION ALL SELECT test_id, label, name, 'threshold:out_of_range' FROM s WHERE name = 'BLEU' AND value > 100
UNION ALL SELECT test_id, label, name, 'threshold:not_a_number' FROM s WHERE name = 'ROUGE'
UNION ALL SELECT test_id, lower(label), NULL, 'duplicate_label' FROM s GROUP BY test_id, lower(label) HAVING count(*) > 1""")
def assignment_problems(spark, sf):
    return A.validate_assignments(_sent(spark, sf), catalogue.check_types(spark))


@query("value_problems")
def value_problems(spark, sf):
    # each word once before it stands under every kind
    d = world.table(spark, sf, "documents").select(F.explode(F.split("text", "\\s+")).alias("value")).distinct()
    kinds = F.explode(F.array(*[F.lit(k) for k in ("regex", "json", "jsonpath", "json_schema")])).alias("kind")
    return A.validate_values(d.select("value", kinds))


@query("tests_missing_reference", "SELECT test_id, t.test_type AS name FROM entries CROSS JOIN labels3 t WHERE expected_output IS NULL", ["entries", "labels3"])
def tests_missing_reference(spark, sf):
    tests, checks = _tests(spark, sf)
    return A.missing_reference(tests, checks, catalogue.check_types(spark))


def _tests(spark, sf):
    e = world.entries(spark, sf)
    tests = e.select("test_id", "name", "input", "expected_output", "model_output")
    return tests, e.select("test_id", F.explode("assignments").alias("a")).select("test_id", "a.*")


@query("patched_tests", """SELECT test_id, CASE WHEN s_acctbal > 5000 THEN 'renamed' ELSE name END AS name, input,
  CASE WHEN s_acctbal > 5000 THEN NULL WHEN s_acctbal < 1000 THEN 'new' ELSE expected_output END AS expected_output, model_output
FROM entries JOIN supplier ON s_suppkey = test_id""", ["entries"])
def patched_tests(spark, sf):
    s = world.table(spark, sf, "supplier")
    high = s.filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("test_id"), F.expr("array('name', 'input', 'expected_output')").alias("sent"),
        F.lit("renamed").alias("name"), F.lit(None).cast("string").alias("input"), F.lit(None).cast("string").alias("expected_output"), F.lit(None).cast("string").alias("model_output"))
    low = s.filter("s_acctbal < 1000").select(F.col("s_suppkey").alias("test_id"), F.expr("array('expected_output')").alias("sent"),
        F.lit("unsent").alias("name"), F.lit(None).cast("string").alias("input"), F.lit("new").alias("expected_output"), F.lit(None).cast("string").alias("model_output"))
    return A.patch_tests(_tests(spark, sf)[0], high.unionByName(low))


@query("deletable_tests", """SELECT c_custkey AS test_id, c_custkey IN (SELECT o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A') AS held,
  c_custkey IN (SELECT test_id FROM sruns WHERE test_id IS NOT NULL) AS has_runs FROM customer""", ["sruns"])
def deletable_tests(spark, sf):
    li = world.table(spark, sf, "lineitem").filter("l_returnflag = 'A'").join(world.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    held = li.select(F.col("o_custkey").alias("test_id"), F.col("l_suppkey").alias("test_set_id"))
    return A.deletable(world.table(spark, sf, "customer").select(F.col("c_custkey").alias("test_id")), held, world.scope_runs(spark, sf))


@query("sets_with_runs", "SELECT c_custkey AS set_id, c_custkey IN (SELECT set_id FROM sruns WHERE set_id IS NOT NULL) AS has_runs FROM customer", ["sruns"])
def sets_with_runs(spark, sf):
    return A.has_runs(world.table(spark, sf, "customer").select(F.col("c_custkey").alias("set_id")), world.scope_runs(spark, sf), "set_id")


@query("dataset_coverage", "SELECT dataset_id, count(*) AS rows, count(*) FILTER (WHERE id IN (SELECT doc_id FROM labels)) AS covered FROM drows GROUP BY 1", ["drows"])
def dataset_coverage(spark, sf):
    return A.coverage(_text_rows(spark, sf), _made_tests(spark, sf))


view("acct_entries", "SELECT e.*, s_acctbal AS s_acct FROM entries e JOIN supplier ON s_suppkey = entry_id", ["entries"])


# ── snapshots and fan-out ────────────────────────────────────────────────────

@query("snapshots_into_set", "SELECT test_id FROM acct_entries WHERE test_set_id <> 4 AND s_acct > 2000", ["acct_entries"])
def snapshots_into_set(spark, sf):
    return O.snapshot_into_set(_chosen(spark, sf), O.freeze(*_tests(spark, sf)), world.entries(spark, sf), 4)[0].select("test_id")




def _chosen(spark, sf):
    return world.table(spark, sf, "supplier").filter("s_acctbal > 2000").select(F.col("s_suppkey").alias("test_id"))


@query("tests_already_held", "SELECT test_id FROM acct_entries WHERE test_set_id = 4 AND s_acct > 2000", ["acct_entries"])
def tests_already_held(spark, sf):
    return O.snapshot_into_set(_chosen(spark, sf), O.freeze(*_tests(spark, sf)), world.entries(spark, sf), 4)[1]


@query("unlinked_entries", "SELECT entry_id, CASE WHEN s_acct > 2000 THEN NULL ELSE test_set_id END AS test_set_id FROM acct_entries", ["acct_entries"])
def unlinked_entries(spark, sf):
    return O.unlink_entries(world.entries(spark, sf), _chosen(spark, sf).select(F.col("test_id").alias("entry_id"))).select("entry_id", "test_set_id")


def _live(spark, sf):
    """Live tests that drifted: another input above one balance, a changed
    check below another, a new name everywhere."""
    s = world.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("test_id"), "s_acctbal")
    e = world.entries(spark, sf).join(s, "test_id")
    moved = F.transform("assignments", lambda a: F.when((F.col("s_acctbal") < 1000) & (a["label"] == "N"), a.withField(
        "config", F.expr("map('threshold', '0.9')"))).otherwise(a))
    return e.withColumn("input", F.when(F.col("s_acctbal") > 8000, "other").otherwise(F.col("input"))).withColumn("name", F.lit("renamed")).withColumn(
        "assignments", F.reverse(moved)).select("test_id", "name", "input", "expected_output", "model_output", "assignments")


@query("copies_still_matching", "SELECT entry_id, NOT (s_acct > 8000 OR s_acct < 1000) AS matches FROM acct_entries", ["acct_entries"])
def copies_still_matching(spark, sf):
    return O.copy_matches(world.entries(spark, sf), _live(spark, sf)).select("entry_id", "matches")


@query("set_fan_out", "SELECT entry_id, 'set-7' AS execution_id, 'Pending' AS status FROM entries WHERE test_set_id = 7", ["entries"])
def set_fan_out(spark, sf):
    return O.fan_out_set(world.entries(spark, sf), 7, "set-7").select("entry_id", "execution_id", "status")


@query("plan_fan_out", "SELECT entry_id, plan_id, 'plan-' || plan_id AS execution_id FROM entries", ["entries"])
def plan_fan_out(spark, sf):
    return O.fan_out_plan(_links(spark, sf), world.entries(spark, sf))[0].select("entry_id", "plan_id", "execution_id")


def _links(spark, sf):
    return world.table(spark, sf, "nation").select(F.col("n_regionkey").alias("plan_id"), F.col("n_nationkey").alias("test_set_id"))


@query("empty_plan_sets", "SELECT n_nationkey AS test_set_id FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def empty_plan_sets(spark, sf):
    rich = world.entries(spark, sf).join(world.table(spark, sf, "supplier").filter("s_acctbal > 8000").select(F.col("s_suppkey").alias("entry_id")), "entry_id", "left_semi")
    return O.fan_out_plan(_links(spark, sf), rich)[1].select("test_set_id")


@query("replayed_runs", "SELECT 'replay-' || execution_id AS execution_id, run_id AS entry_id, 'Pending' AS status FROM sruns WHERE execution_id IN (SELECT execution_id FROM execs WHERE batch_id IS NULL)", ["sruns", "execs"])
def replayed_runs(spark, sf):
    past = world.executions(spark, sf).filter("batch_id is null")
    runs = world.scope_runs(spark, sf).withColumn("entry_id", F.col("run_id"))
    return O.replay(runs, past).select("execution_id", "entry_id", "status")


@query("standalone_fan_out", "SELECT test_id, 3::INTEGER AS checks, 'Pending' AS status FROM entries", ["entries"])
def standalone_fan_out(spark, sf):
    return O.fan_out_tests(O.freeze(*_tests(spark, sf))).select("test_id", F.size("assignments").alias("checks"), "status")


@query("batch_fan_out", """SELECT entry_id, CAST(i AS INTEGER) AS batch_index, CASE WHEN s_acct < 0 THEN 'A,R' END AS skips FROM acct_entries, generate_series(1, 30) g(i)""", ["acct_entries"])
def batch_fan_out(spark, sf):
    return O.fan_out_batch(world.entries(spark, sf), "B1", 1, 30, _left_out(spark, sf)).select(
        "entry_id", "batch_index", F.array_join("skip_labels", ",").alias("skips"))


def _left_out(spark, sf):
    return world.table(spark, sf, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("entry_id"), F.explode(F.array(F.lit("R"), F.lit("A"))).alias("label"))


@query("wave_fan_out", """SELECT batch_id, entry_id, CAST(i AS INTEGER) AS batch_index FROM (SELECT DISTINCT batch_id, entry_id FROM results), generate_series(101, 120) g(i) WHERE batch_id = 'F' OR i <= 110""", ["results"])
def wave_fan_out(spark, sf):
    runs = world.batch_runs(spark, sf).withColumn("skip_labels", F.lit(None).cast("array<string>"))
    ends = world.plain_results(spark, sf).groupBy("batch_id").agg(F.lit(101).alias("first"), F.when(F.col("batch_id") == "F", 120).otherwise(110).alias("last"))
    return O.fan_out_wave(runs, ends).select("batch_id", "entry_id", "batch_index")


def _asking(spark, sf):
    skips = _left_out(spark, sf).groupBy("entry_id").agg(F.collect_set("label").alias("skip_labels"))
    e = world.entries(spark, sf).join(skips, "entry_id", "left").select(F.col("entry_id"), "assignments", "skip_labels")
    return world.batch_runs(spark, sf).join(e, "entry_id")


@query("asked_checks", "SELECT b.run_id, t.label, t.test_type FROM runs_b b JOIN acct_entries e USING (entry_id) CROSS JOIN labels3 t WHERE NOT (s_acct < 0 AND t.label IN ('A', 'R'))", ["runs_b", "acct_entries", "labels3"])
def asked_checks(spark, sf):
    return O.asked_checks(_asking(spark, sf)).select("run_id", "label", "test_type")


@query("run_check_types", "SELECT DISTINCT b.run_id, t.test_type FROM runs_b b JOIN acct_entries e USING (entry_id) CROSS JOIN labels3 t WHERE NOT (s_acct < 0 AND t.label IN ('A', 'R'))", ["runs_b", "acct_entries", "labels3"])
def run_check_types(spark, sf):
    return O.run_check_types(_asking(spark, sf))


@query("entries_without_checks", "SELECT entry_id, name FROM acct_entries WHERE s_acct < 500", ["acct_entries"])
def entries_without_checks(spark, sf):
    s = world.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entry_id"), "s_acctbal")
    e = world.entries(spark, sf).join(s, "entry_id").withColumn("assignments", F.when(F.col("s_acctbal") >= 500, F.col("assignments")).otherwise(F.slice("assignments", 1, 0)))
    return O.entries_without_checks(e)


@query("sets_holding_tests", """SELECT test_id, test_set_id, test_set_name AS set_name, s_acct > 0 AS has_runs, NOT (s_acct > 8000 OR s_acct < 1000) AS matches FROM acct_entries WHERE s_acct <= 9000""", ["acct_entries"])
def sets_holding_tests(spark, sf):
    held, _ = O.holdings(*_held(spark, sf))
    return held.select("test_id", "test_set_id", "set_name", "has_runs", "matches")


def _held(spark, sf):
    s = world.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entry_id"), "s_acctbal")
    e = world.entries(spark, sf).join(s, "entry_id").withColumn("test_set_id", F.when(F.col("s_acctbal") <= 9000, F.col("test_set_id")))
    sets = world.table(spark, sf, "nation").select(F.col("n_nationkey").alias("test_set_id"), F.col("n_name").alias("name"))
    return e, _live(spark, sf), sets, s.filter("s_acctbal > 0").select("entry_id")


@query("unlinked_copies", "SELECT test_id, count(*) AS unlinked_copies FROM acct_entries WHERE s_acct > 9000 GROUP BY 1", ["acct_entries"])
def unlinked_copies(spark, sf):
    return O.holdings(*_held(spark, sf))[1]

