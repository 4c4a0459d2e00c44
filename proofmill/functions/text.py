"""Text rules shared by every check: trimming, folding, look-alikes, tokens."""
from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters read as a plain one
SPACES = ("\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
          "\u200a\u202f\u205f\u3000")
SINGLE_QUOTES = "\u2018\u2019\u201a\u201b\u02bc"
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f"
HYPHENS = "\u2010\u2011\u2212"
INVISIBLE = "\u200b\u2060\ufeff\u00ad"

# Unicode white space, and the four separators Python also strips
WHITE = "(?U)[\\s\\x1c-\\x1f]"
# texts with none of these are already composed: marks, jamo, singletons
_COMPOSABLE = ("[\\p{M}\\u1100-\\u11ff\\u0374\\u037e\\u0387\\u1f71-\\u1fff\\u2000\\u2001\\u2126\\u212a\\u212b\\u2329\\u232a"
               "\\u2adc\\uf900-\\ufaff\\ufb1d-\\ufb4e\\x{1D15E}-\\x{1D1C0}\\x{2F800}-\\x{2FA1D}]")
_NOT_ASCII = "[^\\x00-\\x7f]"


def slices(columns: tuple[pa.Array, ...], rows: int = 256) -> Iterator[zip]:
    """The rows of Arrow columns, a few at a time: a batch holds thousands of
    whole texts, and Python's copies of them are gone before the next few."""
    for i in range(0, len(columns[0]), rows):
        yield zip(*[c.slice(i, rows).to_pylist() for c in columns])


@F.arrow_udf(T.StringType())
def _compose(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in parts:
        for rows in slices((texts,)):
            yield pa.array([None if t is None else unicodedata.normalize("NFC", t) for t, in rows], pa.string())


def normalize_lookalikes(text: Column) -> Column:
    """Texts that read the same made equal: spaces, quotes and hyphens plain,
    invisible characters gone, accents composed. Only texts that could change
    by composing are sent to Python."""
    old = SPACES + SINGLE_QUOTES + DOUBLE_QUOTES + HYPHENS + INVISIBLE
    new = " " * len(SPACES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(HYPHENS)
    special = "[" + old[:len(new)] + INVISIBLE + "]"
    wide = text.rlike(_NOT_ASCII)
    plain = F.when(wide & text.rlike(special), F.translate(text, old, new)).otherwise(text)
    return F.coalesce(_compose(F.when(wide & text.rlike(_COMPOSABLE), plain)), plain)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"\\A{WHITE}+|{WHITE}+\\z", "")


def fold_case(text: Column) -> Column:
    """Letter case aside. Full folding is approximated by lower case with the
    one common expansion, sharp s."""
    return F.replace(F.lower(text), F.lit("\u00df"), F.lit("ss"))


def words(text: Column) -> Column:
    """Runs of non-white characters."""
    return F.filter(F.split(text, f"{WHITE}+"), lambda w: w != "")


def recorded_answer(text: Column) -> Column:
    """A recorded answer, none when blank."""
    return F.when(strip(text) != "", text)


def name_from_prompt(prompt: Column) -> Column:
    """A one-line name of at most 60 characters, cut between words."""
    line = F.regexp_replace(strip(prompt), f"{WHITE}+", " ")
    head = F.substring(line, 1, 59)
    # a word that ends exactly at the cut stays whole
    whole = F.when(F.substring(line, 60, 1) == " ", head).otherwise(F.regexp_extract(head, "^(.*) [^ ]*$", 1))
    cut = F.when(whole == "", head).otherwise(whole)
    return F.when(F.length(line) <= 60, line).otherwise(F.concat(F.rtrim(cut), F.lit("\u2026")))


def rouge_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def meteor_tokens(text: Column) -> Column:
    """Words and single punctuation marks, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\p{Z}\\s]"), F.lit(0))


def bleu_tokens(text: Column, lowercase: bool) -> Column:
    """The standard mt-eval tokens: markup undone, punctuation set apart."""
    t = F.lower(text) if lowercase else text
    # The steps of the published tokeniser, in its order
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"),
                     ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for pattern, swap in (("([\\{-~\\[-` -&\\(-\\+:-@/])", " $1 "), ("([^0-9])([.,])", "$1 $2 "),
                          ("([.,])([^0-9])", " $1 $2"), ("([0-9])(-)", "$1 $2 ")):
        t = F.regexp_replace(t, pattern, swap)
    return words(t)


_NUMBER = r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|nan|inf|infinity)$"


def number_of(text: Column) -> Column:
    """A text as a number, null where it is none: no suffix letters, as a cast
    would take them."""
    plain = strip(text)
    return F.when(plain.rlike(_NUMBER), plain.try_cast("double"))
