"""The registered queries of these operators over the shared tables, and their SQL."""
from __future__ import annotations

import zlib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm import bpe, kdtree, links, mainline, mixing, periodic, piecemerge, probminhash, quality, resample, secrets, suffixes, templates
from proofmill.llm.tables import table

CORPUS_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CORPUS_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        CORPUS_QUERIES[name] = fn
        if sql is not None:
            CORPUS_ORACLES[name] = sql.strip()
        return fn
    return register



SEARCH_SQL = """
WITH rows AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
once AS (SELECT vec_id, min(v) AS v FROM rows GROUP BY vec_id),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
    FROM once q JOIN once c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM pairs) WHERE rank <= 5"""


@query("op1_vector_search", SEARCH_SQL)
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products for every fiftieth vector, among all."""
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


# texts as hexadecimal digits, two to a byte, so that strings are strings of bytes
REPEATS_SQL = """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
strings AS (SELECT r, p, hash(substr(x, 2 * p + 1, 800)) AS h FROM
    (SELECT r, x, unnest(range(greatest(0, len(x) // 2 - 399))) AS p FROM texts)),
twice AS (SELECT h FROM strings GROUP BY h HAVING count(*) > 1),
flagged AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM strings JOIN twice USING (h)),
spans AS (SELECT r, p, sum((before IS NULL OR p > before + 400)::INT) OVER (PARTITION BY r ORDER BY p) AS span FROM flagged),
runs AS (SELECT r, span, min(p) AS a, max(p) + 400 AS b FROM spans GROUP BY r, span),
gaps AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS from_, lead(a) OVER (PARTITION BY r ORDER BY a) AS next FROM runs),
cut AS (SELECT r, sum(b - a) AS removed, count(*) AS spans,
    string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS rest
    FROM gaps JOIN texts USING (r) GROUP BY r)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(rest, x))) AS kept_sha256
FROM texts LEFT JOIN cut USING (r)"""


def _link_sql(rounds: int = links.ROUNDS) -> str:
    """The rules as a table, the rounds of trust written out one after the other."""
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in links.RULES)
    host = "translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = []
    for i in range(1, rounds + 1):
        steps.append(f"""t{i} AS MATERIALIZED (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (
            SELECT host, 0.15 * trust AS trust, 0.15 * distrust AS distrust FROM t0
            UNION ALL SELECT dst, 0.85 * trust * n / o, 0.0 FROM shared JOIN t{i - 1} ON src = host
            UNION ALL SELECT src, 0.0, 0.85 * distrust * n / i FROM shared JOIN t{i - 1} ON dst = host) GROUP BY host)""")
    return f"""
WITH rules(word, rule, rule_host, rule_path) AS (VALUES {rules}),
read AS (SELECT page_id, {host.format("coalesce(url, '')")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, url, html FROM pages),
judged AS (SELECT read.*, (SELECT arg_max(r, length(r.rule)) FROM rules r
    WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS r FROM read),
linked AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?\\bhref\\s*=\\s*["'']?\\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s>]+)', 1)) AS link FROM read),
edges AS (SELECT src, {host.format("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst FROM linked),
counted AS (SELECT src, dst, count(*) AS n FROM edges WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
shared AS (SELECT *, sum(n) OVER (PARTITION BY src) AS o, sum(n) OVER (PARTITION BY dst) AS i FROM counted),
by_host AS (SELECT host, avg((r.word = 'allow')::int) AS good, avg((r.word = 'block')::int) AS bad FROM judged WHERE r IS NOT NULL GROUP BY host),
t0 AS (SELECT host, coalesce(good / nullif(sum(good) OVER (), 0), 0) AS trust, coalesce(bad / nullif(sum(bad) OVER (), 0), 0) AS distrust FROM by_host),
{", ".join(steps)}
SELECT page_id, host, path, r.rule AS rule,
    coalesce(r.word, CASE WHEN round(distrust, 12) > 0.5 * (round(trust, 12) + round(distrust, 12)) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN t{rounds} USING (host)"""


@query("op2_repeated_passages", REPEATS_SQL)
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 400-byte strings."""
    return suffixes.kept_digests(table(spark, sf_dir, "documents"))


@query("op3_url_filter", _link_sql())
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page by rules and by the trust of its host."""
    return links.filtered(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op4_main_text")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article text of every page."""
    return mainline.extracted(table(spark, sf_dir, "pages"))


def vocabulary() -> tuple[bytes, str]:
    import public_tokenizers
    return Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes(), public_tokenizers.PATTERN


@query("op5_byte_tokens")
def byte_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of what they decode to."""
    return bpe.token_digests(table(spark, sf_dir, "documents"), *vocabulary())


@query("op6_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, the network's beside the patterns'."""
    docs = table(spark, sf_dir, "documents")
    return secrets.findings(docs, secrets.fit(docs))


MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS most FROM sized GROUP BY source),
weighed AS (SELECT *, ([3, 1, 2])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS place, 1.5::DOUBLE * sum(source_size) OVER () AS every FROM by_source),
filling AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
    sum(weight) OVER (ORDER BY most::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rest FROM weighed),
split AS (SELECT *, most::DOUBLE / weight <= (every - before) / rest AS is_full FROM filling),
aims AS (SELECT source, source_size, CASE WHEN is_full THEN most::DOUBLE ELSE
    (every - (sum(CASE WHEN is_full THEN most ELSE 0 END) OVER ())::DOUBLE) * weight / (sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target FROM split),
placed AS (SELECT s.*, a.source_size, a.target, floor(a.target)::BIGINT AS quota,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
    FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
    CASE WHEN size = 0 THEN 0 ELSE size * (quota // source_size) + greatest(0, least(size, quota % source_size - pos)) END::BIGINT AS taken
FROM placed"""


@query("op7_source_mix", MIX_SQL)
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all sources takes."""
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


TEMPLATE_SQL = r"""
WITH texts AS (SELECT DISTINCT doc_id, text FROM documents),
split AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM texts WHERE text IS NOT NULL),
worded AS (SELECT doc_id, text, place, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS raw FROM split),
masked AS (SELECT *, list_transform(raw, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS words FROM worded WHERE len(raw) > 0),
lines AS (SELECT doc_id, text, place, words, array_to_string(raw, ' ') AS body,
    CASE WHEN len(raw) < 5 THEN 'S' || array_to_string(raw, ' ') ELSE len(words)::VARCHAR || ' ' || array_to_string(words[1:3], ' ') END AS leaf FROM masked),
counts AS (SELECT leaf, body, any_value(words) AS words, count(DISTINCT coalesce(doc_id, -1)) AS documents FROM lines GROUP BY leaf, body),
places AS (SELECT leaf, body, documents, len(words) AS len_words, unnest(words) AS word, unnest(range(len(words))) AS place FROM counts),
constants AS (SELECT leaf, place, word, sum(documents) >= 3 AND word <> '<*>' AS fixed FROM places GROUP BY leaf, place, word),
marked AS (SELECT leaf, body, string_agg(CASE WHEN fixed THEN word ELSE '<*>' END, ' ' ORDER BY place) AS shown, any_value(len_words) AS len_words,
    sum(fixed::INT) FILTER (place >= 3) AS same, avg(fixed::INT) FILTER (place >= 3) AS share
    FROM places JOIN constants USING (leaf, place, word) GROUP BY leaf, body),
merged AS (SELECT leaf, body, len_words >= 20 AS long, CASE WHEN share >= 0.6 AND same >= 2 AND left(leaf, 1) <> 'S' THEN 'T' || shown ELSE 'L' || body END AS template FROM marked),
often AS (SELECT leaf, template, min(doc_id) AS first FROM lines JOIN merged USING (leaf, body) GROUP BY leaf, template, long
    HAVING count(DISTINCT coalesce(doc_id, -1)) >= CASE WHEN long THEN 2 ELSE 3 END),
gone AS (SELECT doc_id, text, list(place) AS places FROM lines JOIN merged USING (leaf, body) JOIN often USING (leaf, template)
    WHERE doc_id IS DISTINCT FROM first GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(len(list_filter(string_split(d.text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))), 0)::BIGINT AS n_lines,
    coalesce(len(places), 0)::BIGINT AS n_dropped,
    CASE WHEN places IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(places, i - 1)), chr(10)) END AS text
FROM documents d LEFT JOIN gone g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND d.text = g.text"""


@query("op8_line_templates", TEMPLATE_SQL)
def line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose template recurs across documents."""
    return templates.cleaned(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


@query("op9_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document: the smallest id of its near duplicates."""
    return probminhash.classes(table(spark, sf_dir, "documents"))


@query("op10_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the classifier's verdict for every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.fit(docs, table(spark, sf_dir, "labels"))).drop("probability")


def replanted(doc_id, words: list[bytes]) -> list[bytes]:
    """In one document of ten, by its id, all words from some place on repeat
    with one period."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


# the CRC-32 of the bytes of a text, by a table of what eight bits do
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list(list_reduce(list_prepend(n, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY n) AS t FROM range(256) r(n))"


def _crc_sql(column: str) -> str:
    octets = f"list_transform(range(octet_length(encode({column}))), lambda i: ('0x' || substr(hex(encode({column})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda s, b: xor(s >> 8, t[1 + (xor(s, b) & 255)])), 4294967295)"


RUNS_SQL = rf"""
WITH {_CRC_TABLE},
split AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
told AS (SELECT r, doc_id, w, len(w) AS n, {_crc_sql("coalesce(doc_id::VARCHAR, '')")} AS h FROM split, crc),
aims AS (SELECT *, (h // 10) % greatest(n, 1) AS a, doc_id IS NOT NULL AND h % 10 = 0 AND n > 0 AS planted FROM told),
again AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM aims),
texts AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM again),
grams AS (SELECT r, i, hash(w[i + 1:i + 6]) AS g FROM (SELECT r, w, unnest(range(n - 5)) AS i FROM texts WHERE n >= 12)),
pairs AS (SELECT x.r, x.i, y.i - x.i AS d FROM grams x JOIN grams y ON x.r = y.r AND x.g = y.g AND x.i < y.i),
stretches AS (SELECT r, d, min(i) AS start, count(*) + 5 AS depth FROM (
    SELECT r, d, i, i - row_number() OVER (PARTITION BY r, d ORDER BY i) AS island FROM pairs) GROUP BY r, d, island),
runs AS (SELECT r, start, depth + d AS length, min(d) AS period FROM stretches WHERE depth >= d AND depth + d >= 12 GROUP BY r, start, depth + d),
told_runs AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS shown,
    arg_min({{'s': start, 'l': length, 'p': period}}, (-length, start, period)) AS best FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
rest AS (SELECT r, string_agg(w[i + 1], ' ' ORDER BY i) AS kept FROM (SELECT r, w, unnest(range(n)) AS i FROM texts) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period,
    (1000 * best.l // best.p)::BIGINT AS exponent_milli, sha256(coalesce(shown, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM texts LEFT JOIN told_runs USING (r) LEFT JOIN rest USING (r)"""


@query("op11_periodic_runs", RUNS_SQL)
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often and how long each document repeats itself without a gap."""
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), reread=replanted)
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    shown = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.when(F.size("runs") > 0, longest)
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.s").alias("start"), (-F.col("_best.l")).alias("length"), F.col("_best.p").alias("period"),
        F.floor(-1000 * F.col("_best.l") / F.col("_best.p")).cast("long").alias("exponent_milli"),
        F.sha2(shown, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


RESAMPLE_SQL = rf"""
WITH {_CRC_TABLE},
texts AS (SELECT row_number() OVER () AS r, doc_id, text, true AS own FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, false FROM benchmark),
split AS (SELECT r, doc_id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (SELECT r, own, array_to_string(w[i:i + k - 1], ' ') AS f FROM (SELECT r, own, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, range(1, 4) g(k))),
hashed AS (SELECT f, {_crc_sql("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM features), crc),
counts AS (SELECT b AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM range(10000) x(b) LEFT JOIN
    (SELECT bucket, sum(own::INT) AS s, sum((NOT own)::INT) AS t FROM features JOIN hashed USING (f) GROUP BY bucket) ON b = bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((sum(s) OVER ()) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((sum(t) OVER ()) + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
weights AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE own GROUP BY r),
scored AS (SELECT doc_id, len(w) AS n, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
    FROM split LEFT JOIN weights USING (r) WHERE own),
placed AS (SELECT *, row_number() OVER (ORDER BY n >= 20 DESC, score DESC, doc_id NULLS LAST, n_features, weight) AS place, sum((n >= 20)::INT) OVER () AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n >= 20 AND place <= 5 * fit // 100 THEN place END::BIGINT AS rank FROM placed"""


@query("op12_importance_resampling", RESAMPLE_SQL)
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn by their likeness to the benchmark's texts."""
    return resample.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def piece_model() -> bytes:
    import public_tokenizers
    return Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


@query("op13_token_counts")
def piece_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens each document has, and whether they pass the limit."""
    return piecemerge.token_counts(table(spark, sf_dir, "documents"), piece_model(), 4096)
