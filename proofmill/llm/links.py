"""URL filters: allow and block rules, and trust carried over the links of hosts.

Pages that no rule fits are judged by their host. Trust starts from hosts with
allowed pages and flows along links (personalised PageRank); distrust starts
from hosts with blocked pages and flows against them, from a page to those
that link to it. A host is blocked when distrust is the larger share. Rounds
go on until no host's score changes by more than `TOLERANCE` of itself.
"""
from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill.llm.tables import written

ROUNDS, DAMPING, BLOCK_SHARE, CUT_EVERY, SALTS = 8, 0.85, 0.5, 4, 16  # ROUNDS: those the SQL writes out
TOLERANCE = 1e-9
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lowered; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: str, host: Column, path: Column) -> Column:
    name, _, rest = rule.partition("/")
    return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in reversed(longest):
        rule = F.when(fits(text, host, path), F.lit(text)).otherwise(rule)
        verdict = F.when(fits(text, host, path), F.lit(word)).otherwise(verdict)
    return rule, verdict


def edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts. Pages of a hot host are
    counted before the shuffle, so an edge is one row however often it occurs."""
    out = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("_to"))
    out = out.select("src", host_of(F.when(F.col("_to").startswith("//"), F.concat(F.lit("http:"), F.col("_to"))).otherwise(F.col("_to"))).alias("dst"))
    return out.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def seeds(judged: DataFrame) -> DataFrame:
    """(host, trust, distrust): shares of a host's ruled pages by verdict, each
    scaled to sum to one over all hosts."""
    by = judged.filter("rule is not null").groupBy("host").agg(
        F.avg((F.col("verdict") == "allow").cast("double")).alias("good"), F.avg((F.col("verdict") == "block").cast("double")).alias("bad"))
    total = by.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()  # two numbers
    share = lambda c: F.col(c) / total[c] if total[c] else F.lit(0.0)
    return by.select("host", share("good").alias("trust"), share("bad").alias("distrust"))


def blocked(trust: Column, distrust: Column) -> Column:
    """Whether distrust is the larger share, at any size of the scores."""
    return distrust > BLOCK_SHARE * (1 + TOLERANCE) * (trust + distrust)


def spread_trust(links: DataFrame, start: DataFrame, rounds: int | None = None) -> DataFrame:
    """(host, trust, distrust) once they have settled, or after `rounds` rounds.
    A host shares its trust among the hosts it links to and its distrust among
    those that link to it, by numbers of links; mass with nowhere to go is dropped."""
    out_of = links.groupBy("src").agg(F.sum("n").alias("_out"))
    into = links.groupBy("dst").agg(F.sum("n").alias("_in"))
    shared = written(links.join(out_of, "src").join(into, "dst").select(
        "src", "dst", (F.col("n") / F.col("_out")).alias("forth"), (F.col("n") / F.col("_in")).alias("back")), "edges")
    if shared.isEmpty():
        rounds = 1  # nothing flows: every round gives the same
    base = start.select("host", (F.col("trust") * (1 - DAMPING)).alias("trust"), (F.col("distrust") * (1 - DAMPING)).alias("distrust"))
    now = last = start
    for i in range(1, rounds + 1) if rounds else count(1):
        forth = shared.join(now.filter("trust > 0").select(F.col("host").alias("src"), "trust"), "src").select(
            F.col("dst").alias("host"), (F.col("trust") * F.col("forth") * DAMPING).alias("trust"), F.lit(0.0).alias("distrust"))
        back = shared.join(now.filter("distrust > 0").select(F.col("host").alias("dst"), "distrust"), "dst").select(
            F.col("src").alias("host"), F.lit(0.0).alias("trust"), (F.col("distrust") * F.col("back") * DAMPING).alias("distrust"))
        now = reduce(DataFrame.unionByName, [base, forth, back]).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if i % CUT_EVERY == 0:
            now = written(now, "trust")
            if rounds is None:
                before = last.select("host", F.col("trust").alias("_t"), F.col("distrust").alias("_d"))
                moved = lambda x, y: F.abs(F.col(x) - F.coalesce(F.col(y), F.lit(0.0))) > TOLERANCE * F.col(x)
                if now.join(before, "host", "left").filter(moved("trust", "_t") | moved("distrust", "_d")).isEmpty():
                    return now
                last = now
    return now


def filtered(pages: DataFrame, rules=RULES, rounds: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of each row of `pages`.

    A null url, or one without `://`, has empty host and path. A host that
    neither a rule nor a link reaches has no distrust and is allowed. Repeated
    rows are judged alike; other columns are not read.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = read.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    found = spread_trust(edges(pages), seeds(judged), rounds)
    scores = found.select("host", F.round("trust", 12).alias("trust"), F.round("distrust", 12).alias("distrust"), blocked(F.col("trust"), F.col("distrust")).alias("_bad"))
    # a rule settles its pages: only the others need their host's scores looked up
    ruled = judged.filter("rule is not null").withColumns({"trust": F.lit(None).cast("double"), "distrust": F.lit(None).cast("double")})
    # pages of one host are dealt over SALTS tasks; scores hold one row per host and are copied to each
    salted = judged.filter("rule is null").withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    copies = scores.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    other = salted.join(copies, ["host", "_salt"], "left").fillna(0.0, ["trust", "distrust"]).withColumn("verdict", F.when(F.col("_bad"), "block").otherwise("allow"))
    return ruled.unionByName(other.select(ruled.columns))
