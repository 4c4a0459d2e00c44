"""Wording metrics: ROUGE, BLEU, METEOR.

Both texts of a check stand in one row, so n-gram overlaps and longest common
subsequences are counted inside the row: one exchange of whole texts, and
nothing wider is ever made. Texts are cut into words in the JVM; the words of
a row go to a short Arrow function as one string per side. (Exploding every
gram and grouping by it was measured at several times the cost.)

One such function counts for all metrics, each row by its own, so rows of
different metrics share a pass. METEOR aligns positions in the row as well.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.stem import stemmer_of
from ...functions.text import bleu_tokens, meteor_tokens, rouge_tokens, slices

KEYS = ["run_id", "label"]


def _spread(df: DataFrame) -> DataFrame:
    """Rows spread by run. Scoring costs seconds per megabyte of text and moving
    it hundredths, so an even spread pays for itself."""
    return df.repartition(*KEYS)


def _measure(name: str, hits: Column, answer: Column, reference: Column) -> Column:
    precision = F.when(answer > 0, hits / answer).otherwise(0.0)
    recall = F.when(reference > 0, hits / reference).otherwise(0.0)
    if name == "precision":
        return precision
    if name == "recall":
        return recall
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def _overlaps(answer: list[str], reference: list[str], orders: range) -> list[float]:
    """Clipped overlap of word runs: hits, runs in the answer, runs in the
    reference, for each length."""
    out: list[float] = []
    for n in orders:
        left, right = (Counter(zip(*[words[i:] for i in range(n)])) for words in (answer, reference))
        small, large = sorted((left, right), key=len)
        out += [float(sum(min(count, large[run]) for run, count in small.items() if run in large)),
                float(max(len(answer) - n + 1, 0)), float(max(len(reference) - n + 1, 0))]
    return out


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table per bit."""
    places, full = _places(b), (1 << len(b)) - 1
    row = full
    for word in a:
        if word in places:
            hit = row & places[word]
            row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def _places(words: list[str]) -> dict[str, int]:
    """A bit for each place of each word."""
    places: dict[str, int] = {}
    for j, word in enumerate(words):
        places[word] = places.get(word, 0) | (1 << j)
    return places


def _lcs_places(ref: list[str], can: list[str], places: dict[str, int]) -> set[int]:
    """Positions of `ref` on a longest common subsequence with `can`, whose
    words stand at `places`. Only words of both texts are walked through."""
    shared = [i for i, word in enumerate(ref) if word in places]
    full = (1 << len(can)) - 1
    rows = [full]
    for i in shared:
        row = rows[-1]
        hit = row & places[ref[i]]
        rows.append(((row + hit) | (row - hit)) & full)
    length = len(can) - rows[-1].bit_count()
    if length == len(shared):  # all of them, so no way back has to be found
        return set(shared)
    found, i, j = set(), len(shared), len(can)
    here, above = length, len(can) - rows[i - 1].bit_count()  # common to the first i and j words, and i - 1 and j
    while here:
        if ref[shared[i - 1]] == can[j - 1]:
            found.add(shared[i - 1])
            i, j = i - 1, j - 1
        elif here > above and rows[i] >> (j - 1) & 1:
            above -= not rows[i - 1] >> (j - 1) & 1
            j -= 1
            continue
        else:
            i -= 1
        if not i:
            break
        low = (1 << j) - 1
        here, above = j - (rows[i] & low).bit_count(), j - (rows[i - 1] & low).bit_count()
    return found


def _union_hits(refs: list[list[str]], cans: list[list[str]]) -> int:
    """Sentence by sentence: reference words on a common subsequence with any
    answer sentence, each word used as often as both texts hold it. Equal
    sentences are compared once, and only with sentences of a common word."""
    left_r, left_c = Counter(w for s in refs for w in s), Counter(w for s in cans for w in s)
    others = [(can, _places(can)) for can in map(list, dict.fromkeys(map(tuple, cans)))]
    having: dict[str, list[int]] = {}
    for k, (_, places) in enumerate(others):
        for word in places:
            having.setdefault(word, []).append(k)
    known: dict[tuple, list[int]] = {}
    total = 0
    for ref in refs:
        if tuple(ref) not in known:
            near = {k for word in set(ref) for k in having.get(word, ())}
            known[tuple(ref)] = sorted(set().union(*[_lcs_places(ref, *others[k]) for k in near]))
        for i in known[tuple(ref)]:
            if left_r[ref[i]] > 0 and left_c[ref[i]] > 0:
                left_r[ref[i]] -= 1
                left_c[ref[i]] -= 1
                total += 1
    return total


def _chain(pairs: list[tuple[int, int]]) -> int:
    """Runs of pairs that follow each other in both texts."""
    pairs.sort()
    return sum(1 for k, (i, j) in enumerate(pairs) if not k or (i - pairs[k - 1][0], j - pairs[k - 1][1]) != (1, 1))


def _aligned(answer: list[str], reference: list[str], stems: Callable | None, groups: dict[str, list[str]]) -> list[float]:
    """Pairs, chunks and both sizes of an alignment: the same word, the same
    stem, a common group of stems. What repeats pairs up from the end of both
    texts, the last with the last; a word of several groups takes the latest
    place any of them offers."""
    names = [[[w] for w in t] for t in (answer, reference)]
    stemmed = [stems(t) if stems else t for t in (answer, reference)]
    stages = [names]
    if stems:
        stages.append([[[w] for w in t] for t in stemmed])
    if groups:
        stages.append([[groups.get(w, []) for w in t] for t in stemmed])
    left_a, left_r = range(len(answer)), range(len(reference))
    pairs: list[tuple[int, int]] = []
    for keys_a, keys_r in stages:
        places: dict[str, list[int]] = {}
        for j in left_r:
            for key in keys_r[j]:
                places.setdefault(key, []).append(j)
        used_a, used_r = set(), set()
        for i in reversed(left_a):
            best = -1
            for key in keys_a[i]:
                open_ = places.get(key)
                while open_ and open_[-1] in used_r:
                    open_.pop()
                if open_:
                    best = max(best, open_[-1])
            if best >= 0:
                pairs.append((i, best))
                used_a.add(i)
                used_r.add(best)
        left_a = [i for i in left_a if i not in used_a]
        left_r = [j for j in left_r if j not in used_r]
    return [float(len(pairs)), float(_chain(pairs)), float(len(answer)), float(len(reference))]


def counted_by(groups: dict[str, list[str]] | None = None):
    """The Arrow function (metric, answer, reference, variant, stemmed) that
    counts what each row's metric needs; words are separated by spaces, for
    ROUGE sentences by newlines. `groups`: the synonym groups of stems."""
    known = groups or {}

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def counts(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        stems, all_stems = stemmer_of(4), stemmer_of(1)

        def rouge_row(answer, reference, variant, stemmed):
            shape = stems if stemmed else (lambda words: words)
            if variant == "rougeLsum":
                cans, refs = ([shape(s.split()) for s in t.split("\n") if s.strip()] for t in (answer, reference))
                return [float(_union_hits(refs, cans)), float(sum(map(len, cans))), float(sum(map(len, refs)))]
            a, r = shape(answer.split()), shape(reference.split())
            if variant == "rougeL":
                return [float(_lcs(a, r)), float(len(a)), float(len(r))]
            n = int(variant[5:])
            return _overlaps(a, r, range(n, n + 1))

        def one(metric, answer, reference, variant, stemmed):
            if metric is None or answer is None or reference is None:
                return None
            if metric == "rouge":
                return None if variant is None else rouge_row(answer, reference, variant, stemmed)
            if metric == "bleu":
                return _overlaps(answer.split(), reference.split(), range(1, 5))
            return _aligned(answer.split(), reference.split(), all_stems if stemmed else None, known)

        for columns in parts:
            for rows in slices(columns):
                yield pa.array([one(*row) for row in rows], pa.list_(pa.float64()))

    return counts


ROUGE_VARIANT = "^rouge([1-9]|L|Lsum)$"


def shaped(metric: Column, name: str, lowercase: Column) -> Column:
    """A text as its metric's words, separated by spaces."""
    text = F.col(name)
    lines = F.array_join(F.transform(F.split(text, "\n"), lambda s: F.array_join(rouge_tokens(s), " ")), "\n")
    bleu_words = F.array_join(bleu_tokens(F.when(lowercase, F.lower(text)).otherwise(text), False), " ")
    return F.when(metric == "rouge", lines).when(metric == "bleu", bleu_words).when(metric == "meteor", F.array_join(meteor_tokens(text), " "))


def rouge_score(counts: Column, measure: Column) -> Column:
    score = lambda m: _measure(m, counts[0], counts[1], counts[2])
    found = F.when(measure == "precision", score("precision")).when(measure == "recall", score("recall")).when(measure == "f1", score("f1"))
    return F.when(counts.isNotNull(), found)


def bleu_score(counts: Column, kind: Column) -> Column:
    hits, total = [counts[3 * n] for n in range(4)], [counts[3 * n + 1] for n in range(4)]
    ref_len = counts[2]
    logs, used, zeros, reached = F.lit(0.0), F.lit(0), F.lit(0), F.lit(True)
    for n in range(4):
        bump = F.when(kind == "add-k", 1.0).otherwise(0.0) if n else F.lit(0.0)
        h, t = hits[n] + bump, total[n] + bump
        reached = reached & (t > 0)
        zeros = zeros + F.when(reached & (h == 0), 1).otherwise(0)
        empty = F.when(kind == "exp", 100 / (F.pow(F.lit(2.0), zeros) * t)).when(kind == "floor", 100 * 0.1 / t).otherwise(0.0)
        precision = F.when(h > 0, 100 * h / t).otherwise(empty)
        logs = logs + F.when(reached, F.when(precision > 0, F.ln(precision)).otherwise(-9999999999.0)).otherwise(0.0)
        used = used + F.when(reached, 1).otherwise(0)
    brevity = F.when(total[0] >= ref_len, 1.0).otherwise(F.exp(1 - ref_len / total[0]))
    something = hits[0] + hits[1] + hits[2] + hits[3] > 0
    score = F.when(something, brevity * F.exp(logs / used)).otherwise(0.0)
    return F.when(counts.isNotNull() & kind.isin("exp", "floor", "add-k", "none"), score)


def meteor_score(counts: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    m, chunks = counts[0], counts[1]
    p, r = m / counts[2], m / counts[3]
    score = p * r / (alpha * p + (1 - alpha) * r) * (1 - gamma * F.pow(chunks / m, beta))
    return F.when(counts.isNotNull(), F.when(m > 0, score).otherwise(0.0))


def _as_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _counted(df: DataFrame, metric: str, variant: Column, stemmed: Column, lowercase: Column, keep: dict[str, Column], groups: dict | None = None) -> DataFrame:
    """Every row, `keep`, and `_o`, what the metric counts: null, like the score,
    where a text is missing."""
    name = F.lit(metric)
    rows = _spread(df).select(*KEYS, shaped(name, "answer", lowercase).alias("ta"), shaped(name, "reference", lowercase).alias("tr"),
                              variant.alias("v"), stemmed.alias("st"), *[c.alias(n) for n, c in keep.items()])
    return rows.withColumn("_o", counted_by(groups)(name, "ta", "tr", "v", "st"))


def rouge(df: DataFrame, variant: Column | str = "rougeL", measure: Column | str = "f1", stemmer: Column | bool = True) -> DataFrame:
    """run_id, label, raw_score. Variant, measure and stemming may differ by row."""
    v = _as_column(variant)
    counted = _counted(df.filter(v.rlike(ROUGE_VARIANT)), "rouge", v, _as_column(stemmer), F.lit(False), {"ms": _as_column(measure)})
    return counted.select(*KEYS, rouge_score(F.col("_o"), F.col("ms")).alias("raw_score"))


def rouge_n(df: DataFrame, n: int, measure: str = "f1", stemmer: bool = False) -> DataFrame:
    """Shared runs of n words."""
    return rouge(df, f"rouge{n}", measure, stemmer)


def rouge_l(df: DataFrame, measure: str = "f1", stemmer: bool = False) -> DataFrame:
    """Longest common subsequence of words."""
    return rouge(df, "rougeL", measure, stemmer)


def rouge_lsum(df: DataFrame, measure: str = "f1", stemmer: bool = False) -> DataFrame:
    """The same sentence by sentence (split on newlines), union of matches."""
    return rouge(df, "rougeLsum", measure, stemmer)


def bleu(df: DataFrame, smooth: Column | str = "exp", lowercase: Column | bool = False) -> DataFrame:
    """Sentence BLEU up to four words, 0-100. Smoothing (exp, floor, add-k,
    none) and case may differ by row."""
    counted = _counted(df, "bleu", F.lit(None).cast("string"), F.lit(False), _as_column(lowercase), {"s": _as_column(smooth)})
    return counted.select(*KEYS, bleu_score(F.col("_o"), F.col("s")).alias("raw_score"))


SENT_SYNONYMS = 200_000  # rows of a synonym table that is sent along


def synonym_groups(synonyms: DataFrame | None) -> dict[str, list[str]]:
    """A synonym table (word, group) by word. It is a vocabulary, sent to every
    task, so its size is checked first."""
    if synonyms is None:
        return {}
    rows = synonyms.select("word", F.col("group").cast("string").alias("g")).dropna().distinct().limit(SENT_SYNONYMS + 1).collect()
    if len(rows) > SENT_SYNONYMS:
        raise ValueError(f"a synonym table of more than {SENT_SYNONYMS} rows is no vocabulary; select the words of the texts first")
    out: dict[str, list[str]] = {}
    for word, group in sorted(map(tuple, rows)):
        out.setdefault(word, []).append(group)
    return out


def meteor(df: DataFrame, alpha: Column | float = 0.9, beta: Column | float = 3.0, gamma: Column | float = 0.5, stemmer: bool = False,
           synonyms: DataFrame | None = None) -> DataFrame:
    """Unigram alignment: the same word, then the same stem, then the same
    synonym group (`synonyms`: word, group; words as the stem step left them)."""
    keep = {n: _as_column(float(x) if isinstance(x, (int, float)) else x) for n, x in (("al", alpha), ("be", beta), ("ga", gamma))}
    counted = _counted(df, "meteor", F.lit(None).cast("string"), F.lit(stemmer), F.lit(False), keep, synonym_groups(synonyms))
    return counted.select(*KEYS, meteor_score(F.col("_o"), F.col("al"), F.col("be"), F.col("ga")).alias("raw_score"))
