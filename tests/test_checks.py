"""Scoring operators on small inputs, against plain Python where there is one."""
import random

import brute
import pytest
from pyspark.sql import functions as F

from proofmill.functions import text as X
from proofmill.functions.stem import stem
from proofmill.operators.checks import fixed, overlap
from proofmill.operators.checks.dispatch import Sides, score_checks
from proofmill.sources.catalogue import CHECK_TYPES, check_types, engine_specs, stat_tests, validate_catalogue

CHECK = ("run_id int, label string, answer string, reference string, config map<string,string>, "
         "engine_settings map<string,string>, comparison string")


def rows(spark, items):
    return spark.createDataFrame([(i, "x", a, r, c, s, None) for i, (a, r, c, s) in enumerate(items)], CHECK)


def results(df):
    return [(r["passed"], r["errored"], r["detail"]) for r in df.orderBy("run_id").collect()]


def test_exact_match_reads_lookalikes_alike(spark):
    got = results(fixed.check_exact(rows(spark, [
        ("It’s “fine” now\n", "It's \"fine\" now", {}, {}), ("café", "café", {}, {}),
        ("a​b", "ab", {}, {}), ("m²", "m2", {}, {}), ("A", "a", {}, {}), ("A", "a", {}, {"case_sensitive": "false"}),
        (" a", "a", {}, {"trim": "false"}), ("x", None, {}, {}), ("straße", "STRASSE", {}, {"case_sensitive": "false"})])))
    assert [g[0] for g in got] == [True, True, True, False, False, True, False, False, True]
    assert got[7][1:] == (True, "no_reference")


def test_regex_dialect_time_and_invalid_patterns(spark):
    got = results(fixed.check_regex(rows(spark, [
        ("order 4471", None, {"pattern": r"\d{4}"}, {}), ("abc", None, {"pattern": "b"}, {"mode": "fullmatch"}),
        ("abc", None, {"pattern": "("}, {}), ("abc", None, {}, {}), ("a" * 40 + "!", None, {"pattern": "^(a+)+$"}, {"timeout_seconds": "0.2"}),
        ("foobar", None, {"pattern": "(?<=foo)bar"}, {}), ("x", None, {"pattern": "x"}, {"mode": "other"}),
        ("٤", None, {"pattern": r"\d"}, {}), ("line\nend", None, {"pattern": "line$"}, {})])))
    assert got[4] in ((False, False, "timeout"), (False, False, "no_match"))  # the engine may see through this one
    del got[4]
    assert got == [(True, False, None), (False, False, "no_match"), (False, True, "invalid_pattern"), (False, True, "no_pattern"),
                   (True, False, None), (False, True, "unknown_mode"), (True, False, None), (False, False, "no_match")]


def test_json_checks(spark):
    got = results(fixed.check_json_field(rows(spark, [
        ('{"a": 1.0}', None, {"path": "$.a", "value": "1"}, {}), ('{"a": true}', None, {"path": "a", "value": "1"}, {}),
        ('{"a": {"y": 1, "x": [2]}}', None, {"path": "$.a", "value": '{"x": [2], "y": 1}'}, {}), ('{"a": "42"}', None, {"path": "$.a", "value": "42"}, {}),
        ("```json\n{\"a\": [7]}\n```", None, {"path": "$.a[0]", "value": "7"}, {}), ("{}", None, {"path": "$.a", "value": "1"}, {}),
        ("nope", None, {"path": "$.a", "value": "1"}, {}), ('{"a": 1}', None, {"path": "$..a", "value": "1"}, {})])))
    assert [g[0] for g in got] == [True, False, True, False, True, False, False, False]
    assert [g[2] for g in got][5:] == ["nothing_at_path", "not_json", "invalid_path"]
    schema = '{"type": "array", "items": {"enum": ["a", 1]}, "minItems": 1}'
    got = results(fixed.check_json_schema(rows(spark, [('["a", 1.0]', None, {"schema": schema}, {}), ('["b"]', None, {"schema": schema}, {}),
                                                       ("[]", None, {"schema": schema}, {}), ("[]", None, {"schema": "{}"}, {})]), [schema]))
    assert [g[:2] for g in got] == [(True, False), (False, False), (False, False), (False, True)]


def texts(spark, n=40):
    rng = random.Random(3)
    words = "the cat sat, on a mat. And (then) 3-4 dogs ran; running cities agreed x9".split()
    pick = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
    pairs = [(pick(), pick()) for _ in range(n)]
    return pairs, spark.createDataFrame([(i, "x", a, r) for i, (a, r) in enumerate(pairs)], "run_id int, label string, answer string, reference string")


def raw(df):
    return [r["raw_score"] for r in df.orderBy("run_id").collect()]


def test_wording_metrics_match_plain_python(spark):
    pairs, df = texts(spark)
    for smooth in ("exp", "floor", "add-k", "none"):
        assert raw(overlap.bleu(df, smooth)) == pytest.approx([brute.bleu(a, r, smooth) for a, r in pairs], abs=1e-9)
    words = [(brute.rouge_words(a), brute.rouge_words(r)) for a, r in pairs]
    for n in (1, 3):
        want = [brute.f1(sum((brute.grams(a, n) & brute.grams(r, n)).values()), max(len(a) - n + 1, 0), max(len(r) - n + 1, 0)) for a, r in words]
        assert raw(overlap.rouge_n(df, n)) == pytest.approx(want)
    assert raw(overlap.rouge_l(df)) == pytest.approx([brute.f1(brute.lcs(a, r), len(a), len(r)) for a, r in words])
    stems = [([stem(w) if len(w) > 3 else w for w in a], [stem(w) if len(w) > 3 else w for w in r]) for a, r in words]
    assert raw(overlap.rouge_l(df, stemmer=True)) == pytest.approx([brute.f1(brute.lcs(a, r), len(a), len(r)) for a, r in stems])
    import re
    mt = [[re.findall(r"\w+|[^\w\s]", t.lower()) for t in pair] for pair in pairs]
    assert raw(overlap.meteor(df)) == pytest.approx([brute.meteor(a, r) for a, r in mt], abs=1e-9)


def test_lsum_is_l_on_one_line_and_counts_each_sentence(spark):
    df = spark.createDataFrame([(0, "x", "b a\nd c", "a b\nc d"), (1, "x", "a b c d", "a b c d")], "run_id int, label string, answer string, reference string")
    assert raw(overlap.rouge_lsum(df)) == pytest.approx([0.5, 1.0])


def test_stems():
    pairs = {"arrives": "arriv", "arrive": "arriv", "ponies": "poni", "agreed": "agre", "running": "run", "relational": "relat",
             "hopefulness": "hope", "sky": "sky", "happy": "happi", "controlled": "control", "oscillators": "oscil", "was": "wa"}
    assert {w: stem(w) for w in pairs} == pairs


def test_names(spark):
    long = "word " * 30
    df = spark.createDataFrame([(0, "  a\n b  "), (1, long), (2, "x" * 80), (3, "a" * 59 + " tail")], "i int, t string")
    got = [r["n"] for r in df.select("i", X.name_from_prompt(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == ["a b", ("word " * 12).strip() + "…", "x" * 59 + "…", "a" * 59 + "…"]


def test_dispatch_scores_each_check_by_its_type(spark):
    df = spark.createDataFrame([(0, "a", "Contains", "hello", None, {"substring": "ell"}), (0, "b", "ROUGE-1", "hello there", "hello", {"threshold": "0.5"}),
                                (0, "c", "Nonsense", "hello", None, {}), (0, "d", "Bias", "hello", None, {}), (0, "e", "ROUGE", "hi", None, {"threshold": "0.5"})],
                               "run_id int, label string, test_type string, answer string, reference string, config map<string,string>")
    got = {r["label"]: (r["passed"], r["score"], r["detail"], r["errored"]) for r in score_checks(df, check_types(spark)).collect()}
    assert got["a"] == (True, None, None, False) and got["b"] == (True, pytest.approx(0.6667), None, False)
    assert got["c"][2:] == ("unknown_type", True) and got["d"][2:] == ("no_rubric", True) and got["e"][2:] == ("no_reference", True)


def test_the_catalogue_is_sound(spark):
    assert len(CHECK_TYPES) == 32
    assert validate_catalogue(stat_tests(spark), engine_specs(spark)).count() == 0


def test_every_engine_in_one_pass(spark):
    """Sides come by (run, label); each metric scores as it does alone; the
    checks are read once."""
    schema = "run_id int, label string, test_type string, answer string, reference string, config map<string,string>"
    texts = [("the cat sat on the mat", "the cats sat on a mat."), ("buy a big car", "purchase a large automobile"), ("", "x"), ("same words", "same words")]
    kinds = ["ROUGE", "ROUGE-2", "BLEU", "METEOR", "METEOR (balanced)", "Cosine Similarity", "BERTScore", "Toxicity", "Correctness", "Exact Match"]
    rows = [(i, k, k, a, r, {"threshold": "0.3", "rubric": "Be kind."}) for i, (a, r) in enumerate(texts) for k in kinds]
    df = spark.createDataFrame(rows, schema)
    synonyms = spark.createDataFrame([("buy", 1), ("purchas", 1), ("big", 2), ("larg", 2), ("big", 3), ("car", 4), ("automobil", 4)], "word string, group int")
    vectors = spark.createDataFrame([(0, "Cosine Similarity", [1.0, 0.0], [1.0, 1.0]), (2, "Cosine Similarity", [1.0], [1.0]), (3, "Cosine Similarity", [1.0], [1.0, 2.0])],
                                    "run_id int, label string, answer_vector array<double>, reference_vector array<double>")
    pieces = [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]]
    tokens = spark.createDataFrame([(0, "BERTScore", pieces, pieces)], "run_id int, label string, answer_vectors array<array<double>>, reference_vectors array<array<double>>")
    said = lambda ok: '{"content": [{"type": "tool_use", "input": {"passed": %s, "rationale": "r"}}]}' % str(ok).lower()
    replies = spark.createDataFrame([(0, "Toxicity", said(True)), (1, "Toxicity", said(False)), (2, "Toxicity", "no"), (0, "Correctness", said(True))], "run_id int, label string, body string")
    out = score_checks(df, check_types(spark), sides=Sides(vectors, tokens, replies, synonyms))
    plan = out._jdf.queryExecution().executedPlan().toString()
    # one function each: two texts made plain, wording, patterns, token vectors; one exchange of the checks and one of the sides
    assert plan.count("ArrowEvalPython") == 5 and plan.count("SortMergeJoin") == 1 and plan.count("[counts(") == 1
    assert "engine_not_available" not in {r.detail for r in out.collect()}
    got = {(r.run_id, r.label): (r.passed, r.score, r.detail) for r in out.collect()}
    assert len(got) == len(rows)
    one = lambda k, fn: {r.run_id: round(r.raw_score, 4) for r in fn(df.filter(F.col("label") == k)).collect()}
    for k, fn in (("ROUGE", lambda d: overlap.rouge(d)), ("ROUGE-2", lambda d: overlap.rouge_n(d, 2, stemmer=True)), ("BLEU", lambda d: overlap.bleu(d)),
                  ("METEOR", lambda d: overlap.meteor(d, stemmer=True, synonyms=synonyms)), ("METEOR (balanced)", lambda d: overlap.meteor(d, 0.5, stemmer=True, synonyms=synonyms))):
        assert {i: got[i, k][1] for i in range(4)} == pytest.approx(one(k, fn)), k
    assert one("METEOR", lambda d: overlap.meteor(d, stemmer=True))[1] < 0.2 < 0.9 < got[1, "METEOR"][1]  # a, and three by their synonyms
    assert [got[i, "Cosine Similarity"][1:] for i in range(4)] == [(0.7071, None), (None, "no_vectors"), (0.0, "below_threshold"), (None, "no_vectors")]
    assert got[0, "BERTScore"] == (True, 1.0, None) and got[1, "BERTScore"][2] == "no_vectors"
    assert [got[i, "Toxicity"][::2] for i in range(4)] == [(True, None), (False, "judged_not_passed"), (False, "unreadable"), (False, "no_reply")]
    assert got[0, "Correctness"][0] and got[3, "Exact Match"][0]


def test_numbers_have_no_suffix(spark):
    df = spark.createDataFrame([(0, "l", "Word Count Limit", "a b", None, {"max": "10d"}), (1, "l", "Word Count Limit", "a b", None, {"max": " 10 "}),
                                (2, "l", "Word Count Limit", "a b", None, {"max": "1e1"}), (3, "l", "Word Count Limit", "a b", None, {"max": "5f"})],
                               "run_id int, label string, test_type string, answer string, reference string, config map<string,string>")
    got = {r.run_id: r.detail for r in score_checks(df, check_types(spark), metrics=()).collect()}
    assert got == {0: "max_not_number", 1: None, 2: None, 3: "max_not_number"}


def test_patterns_of_any_length_keep_their_dialect(spark):
    long = "".join(f"[a-z]{i % 7}" for i in range(3000))
    df = spark.createDataFrame([(0, "".join("q" + str(i % 7) for i in range(3000)), {"pattern": long}), (1, "x", {"pattern": "(" * 3000})], "run_id int, answer string, config map<string,string>")
    df = df.withColumns({"label": F.lit("l"), "reference": F.lit(None).cast("string"), "engine_settings": F.expr("map('mode', 'search')"), "comparison": F.lit(None).cast("string")})
    got = {r.run_id: (r.passed, r.detail) for r in fixed.check_regex(df, mode="search", negate=False, lookalikes=False).collect()}
    assert got == {0: (True, None), 1: (False, "invalid_pattern")}


def test_a_missing_text_keeps_its_row_without_a_score(spark):
    df = spark.createDataFrame([(1, "x", "a b", None), (2, "x", None, "a b"), (3, "x", "", "a b"), (4, "x", "a b", "a b")],
                               "run_id int, label string, answer string, reference string")
    for out in (overlap.rouge_n(df, 1), overlap.rouge_l(df), overlap.rouge_lsum(df), overlap.bleu(df), overlap.meteor(df)):
        got = {r.run_id: r.raw_score for r in out.collect()}
        assert set(got) == {1, 2, 3, 4} and got[1] is None and got[2] is None and got[3] == 0 and got[4] > 0


def test_sentences_without_a_common_word_are_not_compared(monkeypatch):
    from proofmill.operators.checks import overlap
    pairs = []
    real = overlap._lcs_places
    monkeypatch.setattr(overlap, "_lcs_places", lambda *x: pairs.append(x[:2]) or real(*x))
    refs = [[f"r{i}", "a", f"s{i}"] for i in range(40)] + [["z", "a"]] * 40
    cans = [[f"c{i}", "b"] for i in range(40)] + [["a", "z", "a"]] * 40
    assert overlap._union_hits(refs, cans) == 40 + 40 + 40  # each a of a reference, each z
    assert len(pairs) == 41


def test_texts_are_made_python_strings_a_few_at_a_time():
    import pyarrow as pa
    from proofmill.functions.text import slices
    columns = (pa.array([str(i) for i in range(1000)]), pa.array(range(1000)))
    parts = [list(rows) for rows in slices(columns)]
    assert sum(parts, []) == [(str(i), i) for i in range(1000)] and max(map(len, parts)) <= 256


def test_documents_of_one_group_are_dealt_to_several_tasks(spark, tmp_path):
    from workload.checks import _copies
    spark.range(400).selectExpr("id AS doc_id", "concat('text ', id % 7) AS text", "'web' AS source", "'en' AS lang").write.parquet(str(tmp_path / "documents.parquet"))
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        rows = _copies(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 400 and {r.reference for r in rows} == {"text 0"} and len({r.task for r in rows}) > 1
