"""Reading JSON text at a path, through the variant type."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# keys and indexes only, what a variant path can hold; an index is an int
_PATH = "^\\$(\\.[A-Za-z_][A-Za-z0-9_-]*|\\[[0-9]{1,9}\\]|\\['[^'\\]]+'\\])*$"
_MARK = "```"
# JSON text in parts: strings, numbers, all between them
_PARTS = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+|-'


def full_path(path: Column) -> Column:
    return F.when(path.startswith("$"), path).otherwise(F.concat(F.lit("$."), path))


def path_is_readable(path: Column) -> Column:
    return full_path(path).rlike(_PATH)


def at_path(document: Column, path: Column) -> Column:
    """The variant at a path, null when nothing is there or the path is not
    readable (such a path never reaches the reader)."""
    safe = F.when(path_is_readable(path), full_path(path)).otherwise(F.lit("$"))
    return F.when(path_is_readable(path), F.try_variant_get(document, safe, "variant"))


def kind_of(value: Column) -> Column:
    """string, number, boolean, null, array or object."""
    name = F.schema_of_variant(value)
    return (F.when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null")
            .when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object")
            .when(name.isNotNull(), "number"))


def answer_of(value: Column) -> Column:
    """The answer a JSON value stands for: a string as it is, null or blank as
    the empty answer, anything else as JSON text."""
    text = F.try_variant_get(value, "$", "string")
    kind = kind_of(value)
    return (F.when(value.isNull(), None).when(kind == "null", "")
            .when(kind == "string", F.when(strip(text) == "", "").otherwise(text))
            .otherwise(F.to_json(value)))


def unfenced(text: Column) -> Column:
    """The inside of a Markdown fence when the whole text is one: its first line
    is a mark and at most a language name, and it ends with a mark."""
    whole = strip(text)
    opening = F.substring_index(whole, "\n", 1)
    language = F.rtrim(F.substr(opening, F.lit(len(_MARK) + 1)), F.lit(" \t"))
    rest = F.substr(whole, F.length(opening) + 2)
    inside = F.rtrim(F.left(rest, F.length(rest) - len(_MARK)), F.lit(" \t"))
    inside = F.when(inside.endswith("\n"), F.left(inside, F.length(inside) - 1)).otherwise(inside)
    fenced = opening.startswith(_MARK) & ~language.rlike("[^A-Za-z]") & rest.endswith(_MARK)
    return F.when(fenced, inside).otherwise(text)


def _number_text(number: Column) -> Column:
    """One spelling for every number of one value; a whole number that no double
    holds keeps its digits."""
    value = number.try_cast("double")
    short = F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("long").cast("string")).otherwise(value.cast("string"))
    exact = value.try_cast("decimal(38,0)").eqNullSafe(number.try_cast("decimal(38,0)"))
    return F.when(number.rlike("[.eE]") | (F.length(number) < 16) | exact, short).otherwise(number)


def _even(value: Column) -> Column:
    """A value's JSON text, keys sorted, its numbers spelled by value at any depth."""
    parts = F.regexp_extract_all(F.to_json(value), F.lit(_PARTS), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^-?[0-9]"), _number_text(x)).otherwise(x)), "")


def same_json(a: Column, b: Column) -> Column:
    """Equal values: numbers by value at any depth, everything else type for
    type, object keys in any order (variant text keeps keys sorted)."""
    return (kind_of(a) == kind_of(b)) & (_even(a) == _even(b))
