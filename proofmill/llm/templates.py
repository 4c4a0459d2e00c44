"""Line dedup by a log-template tree of fixed depth.

A line of `GENERAL` words or more goes down the tree by its number of words
and its first `DEPTH` words; words with a digit count as variable. Inside a
leaf a word is constant at its place when at least `MIN_DOCUMENTS` documents
have it there, and variable otherwise. Lines that differ in variable words
only share a template, provided that behind the leaf's own words at least
`CONSTANT_WORDS` words, and `CONSTANT_SHARE` of all, are constant: the leading
words are equal by descent and prove nothing. Any other line, and a shorter
one, is a template by itself, equal lines only.

A template of `MIN_DOCUMENTS` documents or more recurs, one of `LONG` words or
more from two documents on: its lines stay in the document of the smallest id
and go from all others.

Counting places instead of comparing lines pair by pair makes every step a
sum, so neither a hot line nor a hot leaf meets in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.llm.tables import boxed, unboxed, written

GENERAL, DEPTH, MIN_DOCUMENTS, CONSTANT_WORDS, CONSTANT_SHARE, LONG = 5, 3, 3, 2, 0.6, 20
ANY = "<*>"
SPACE = r"[\x20\x09-\x0D]+"


def _words(line: Column) -> Column:
    return F.filter(F.split(line, SPACE), lambda w: w != "")


def _masked(words: Column) -> Column:
    """The words, those with a digit as the variable word."""
    return F.transform(words, lambda w: F.when(w.rlike("[0-9]"), ANY).otherwise(w))


def _lines(docs: DataFrame) -> DataFrame:
    """Every line with a word, with its document, place and words."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    return lines.withColumn("words", _words(F.col("line"))).filter(F.size("words") > 0).drop("line")


def _leaf() -> Column:
    short = F.size("words") < GENERAL
    return F.when(short, F.xxhash64(F.lit(2), _body())).otherwise(F.xxhash64(F.size("words"), _masked(F.slice("words", 1, DEPTH))))


def _body() -> Column:
    return F.xxhash64(F.lit(1), F.array_join("words", " "))


def _recurs(documents: Column, long: Column) -> Column:
    return documents >= F.when(long, 2).otherwise(MIN_DOCUMENTS)


def recurring(docs: DataFrame) -> DataFrame:
    """(doc_id, version, places): the lines that go, for each text that loses any."""
    lines = written(_lines(docs).select("doc_id", "version", "place", _leaf().alias("leaf"), _body().alias("body"), (F.size("words") >= LONG).alias("long")), "lines")
    # documents of each different line; a line repeated in a document counts once
    counts = written(lines.groupBy("leaf", "body", "long", "doc_id").agg(F.min("version").alias("version"), F.min_by("place", F.struct("version", "place")).alias("place"))
                     .groupBy("leaf", "body", "long").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "version", "place")).alias("shown")), "line-counts")
    leaves = counts.groupBy("leaf").agg(F.sum("documents").alias("n"), F.count(F.lit(1)).alias("bodies"))
    mixed = written(leaves.filter((F.col("n") >= MIN_DOCUMENTS) & (F.col("bodies") > 1)).select("leaf"), "leaves")
    merged = written(_templates(docs, counts, mixed), "templates")
    alone = counts.join(mixed, "leaf", "left_anti").select("leaf", "body", "long", "documents", "first")
    # exact counts where several lines make one template: a document with two of them counts once
    by_template = (lines.select("leaf", "body", "long", "doc_id").join(merged.hint("merge"), ["leaf", "body"])
                   .select("leaf", "template", "long", "doc_id").distinct().groupBy("leaf", "template", "long").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first")))
    together = merged.join(by_template, ["leaf", "template"]).select("leaf", "body", "long", "documents", "first")
    often = written(alone.unionByName(together).filter(_recurs(F.col("documents"), F.col("long"))).select("leaf", "body", "first"), "recurring")
    gone = lines.join(often.hint("merge"), ["leaf", "body"]).filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    return gone.groupBy("doc_id", "version").agg(F.collect_set("place").alias("places"))


def _templates(docs: DataFrame, counts: DataFrame, leaves: DataFrame) -> DataFrame:
    """(leaf, body, template) for the different lines of the given leaves."""
    shown = counts.join(leaves, "leaf", "left_semi").select("shown.*")
    wanted = shown.groupBy("doc_id", "version").agg(F.collect_set("place").alias("places")).withColumnsRenamed({"doc_id": "_id", "version": "_version"})
    # joins that grow with the corpus shuffle at every size, so that small runs tell what large ones take
    held = docs.select("doc_id", "text").join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_version")))
    lines = held.select("places", F.posexplode(F.split("text", "\n", -1)).alias("place", "line")).filter(F.array_contains("places", F.col("place")))
    texts = lines.select(_words(F.col("line")).alias("words")).select("words", _leaf().alias("leaf"), _body().alias("body")).dropDuplicates(["leaf", "body"])
    places = texts.join(counts.select("leaf", "body", "documents"), ["leaf", "body"]).select("leaf", "body", "documents", F.posexplode(_masked(F.col("words"))).alias("at", "word"))
    constant = places.groupBy("leaf", "at", "word").agg(F.sum("documents").alias("n")).filter(F.col("n") >= MIN_DOCUMENTS).select("leaf", "at", "word", F.lit(True).alias("fixed"))
    marked = places.join(constant, ["leaf", "at", "word"], "left").withColumn("fixed", F.col("fixed").isNotNull() & (F.col("word") != ANY))
    shown = F.struct("at", F.when(F.col("fixed"), F.col("word")).otherwise(ANY).alias("word"))
    behind = F.when(F.col("at") >= DEPTH, F.col("fixed").cast("int"))
    whole = marked.groupBy("leaf", "body").agg(F.array_sort(F.collect_list(shown)).alias("words"), F.sum(behind).alias("same"), F.avg(behind).alias("share"))
    general = (F.col("same") >= CONSTANT_WORDS) & (F.col("share") >= CONSTANT_SHARE)
    return whole.select("leaf", "body", F.when(general, F.xxhash64("words")).otherwise(F.col("body")).alias("template"))


def cleaned(docs: DataFrame) -> DataFrame:
    """The columns of `docs`, the text without recurring lines, and n_lines (with
    a word) and n_dropped of each row.

    Null and empty texts have no lines and stay as they are. Repeated rows of
    one document count as one document and lose the same lines; a null id is a
    document of its own, sorted last. Blank lines stay. Columns of `docs` named
    n_lines or n_dropped give way to the counts; all others are carried along,
    whatever their names.
    """
    gone = recurring(docs).withColumnsRenamed({"doc_id": "_id", "version": "_version"})
    joined = boxed(docs).join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_version")), "left")
    lines = F.split("text", "\n", -1)
    rest = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("places", i)), "\n")
    dropped = F.coalesce(F.size("places"), F.lit(0)).cast("long")
    n_lines = F.coalesce(F.size(F.filter(lines, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0)).cast("long")
    joined = joined.withColumn("text", F.when(F.col("places").isNull(), F.col("text")).otherwise(rest)).withColumn("_n", n_lines)
    # n_lines counts the lines of the text as it came
    joined = joined.withColumn("_gone", F.when(F.col("places").isNull(), F.lit(0)).otherwise(dropped).cast("long"))
    return unboxed(joined, [c for c in docs.columns if c not in ("n_lines", "n_dropped")], (F.col("_n") + F.col("_gone")).alias("n_lines"), F.col("_gone").alias("n_dropped"))
