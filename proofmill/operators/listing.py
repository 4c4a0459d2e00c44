"""Filtered, searched, sorted, paged lists and their facets.

A `Listing` is declared once over a DataFrame with one row per key; the page,
the count and the facets all come from that one declaration.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import lit_frame

MAX_PAGE = 500


# ── predicates ───────────────────────────────────────────────────────────────

def among(column: str) -> Callable[[Sequence], Column]:
    return lambda values: F.col(column).isin(*values)


def among_or_absent(column: str, absent: str) -> Callable[[Sequence], Column]:
    """Values, of which one name stands for null."""
    def where(values):
        named = [v for v in values if v != absent]
        there = F.col(column).isin(*named) if named else F.lit(False)
        return F.coalesce(there, F.lit(False)) | (F.col(column).isNull() if absent in values else F.lit(False))
    return where


def contains_text(phrases: Sequence[str], *columns: str) -> Column:
    """Every phrase found, each in any of the columns, as literal text, letter
    case aside."""
    def found(phrase):
        return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lower(F.lit(phrase)))
                                           for c in columns])
    return reduce(lambda a, b: a & b, [found(p) for p in phrases], F.lit(True))


def search(*columns: str) -> Callable[[Sequence], Column]:
    return lambda phrases: contains_text(phrases, *columns)


def created_between(column: str, start, end) -> Column:
    """Half open; either side may be left out."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(column) >= F.lit(start))
    if end is not None:
        out = out & (F.col(column) < F.lit(end))
    return out


def created(column: str = "created_at") -> Callable[[Sequence], Column]:
    return lambda span: created_between(column, span[0], span[1])


def holds_any(column: str) -> Callable[[Sequence], Column]:
    """For a column listing related ids: 'any', 'none', or specific ids."""
    def where(values):
        size = F.coalesce(F.array_size(F.col(column)), F.lit(0))
        tests = {"any": size > 0, "none": size == 0}
        ids = [v for v in values if v not in tests]
        out = F.arrays_overlap(F.col(column), F.array(*[F.lit(v) for v in ids])) if ids else F.lit(False)
        for name in tests:
            if name in values:
                out = F.coalesce(out, F.lit(False)) | tests[name]
        return F.coalesce(out, F.lit(False))
    return where


def membership(df: DataFrame, related: DataFrame, key: str, values: Sequence | str) -> DataFrame:
    """Rows whose key has any / no related row, or one with the given `value`s."""
    if values == "any":
        return df.join(related.select(key), key, "left_semi")
    if values == "none":
        return df.join(related.select(key), key, "left_anti")
    return df.join(related.filter(F.col("value").isin(*values)).select(key), key, "left_semi")


def origin(test: str = "test_id", of_set: str = "set_id", plan: str = "plan_id") -> Column:
    return (F.when(F.col(test).isNotNull(), "standalone").when(F.col(of_set).isNotNull(), "test_set")
            .when(F.col(plan).isNotNull(), "test_plan"))


def batch_filter(column: str = "batch_id") -> Callable[[Sequence], Column]:
    """'none' for runs outside batches, else batch ids; no filter at all when empty."""
    return among_or_absent(column, "none")


# ── facets ───────────────────────────────────────────────────────────────────

@dataclass(frozen=True)
class Facet:
    """What a facet counts: the values of a column (or of an array column,
    each once per key), with a name for null; or named conditions."""
    column: str | None = None
    array: bool = False
    absent: str | None = None
    fixed: tuple[str, ...] = ()
    buckets: dict[str, Column] = field(default_factory=dict)

    def values(self) -> Column:
        if self.buckets:
            return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in self.buckets.items()]))
        if self.array:
            listed = F.array_distinct(F.coalesce(F.transform(F.col(self.column), lambda v: v.cast("string")),
                                                 F.array().cast("array<string>")))
            if self.absent is None:
                return listed
            return F.when(F.array_size(listed) == 0, F.array(F.lit(self.absent))).otherwise(listed)
        value = F.col(self.column).cast("string")
        value = F.coalesce(value, F.lit(self.absent)) if self.absent is not None else value
        return F.array_compact(F.array(value))

    def zeros(self) -> tuple[str, ...]:
        return tuple(self.buckets) or self.fixed


def created_buckets(column: str, edges: dict[str, object]) -> dict[str, Column]:
    """Counts at or after each edge, and before the earliest."""
    first = min(edges.values())
    out = {name: F.col(column) >= F.lit(edge) for name, edge in edges.items()}
    out["before"] = F.col(column) < F.lit(first)
    return out


@dataclass(frozen=True)
class Lookup:
    """A left join a listing may need: one row of `table` per `key`, met by the
    listing's column `on`; `columns` are what it brings, by their names there."""
    table: DataFrame
    on: str
    key: str
    columns: dict[str, str]

    def join(self, df: DataFrame) -> DataFrame:
        side = self.table.select(F.col(self.key).alias("_key"), *[F.col(c).alias(n) for n, c in self.columns.items()])
        return df.join(side, F.col(self.on) == F.col("_key"), "left").drop("_key")


@dataclass(frozen=True)
class Listing:
    """One row per `key` in `df`; `filters` turn chosen values into conditions;
    a facet leaves out the filter of its own name.

    `lookups` are joins made only for what is asked: `reads` names, for a
    filter, facet or sort, the lookups it reads; a page or a list has all
    columns of the lookups in `shows` besides. Columns worked out from a
    lookup's stand in `derived`, by the lookups they need.
    """
    df: DataFrame
    key: str
    filters: dict[str, Callable[[Sequence], Column]] = field(default_factory=dict)
    facets_of: dict[str, Facet] = field(default_factory=dict)
    sorts: dict[str, list[Column]] = field(default_factory=dict)
    lookups: dict[str, Lookup] = field(default_factory=dict)
    reads: dict[str, tuple[str, ...]] = field(default_factory=dict)
    shows: tuple[str, ...] = ()
    derived: dict[str, tuple[Column, tuple[str, ...]]] = field(default_factory=dict)

    def _with(self, *names: str, shows: tuple[str, ...] = ()) -> DataFrame:
        """The rows with the lookups that the named filters, facets or sorts read."""
        wanted = {x for n in names for x in self.reads.get(n, ())} | set(shows)
        df = reduce(lambda d, name: self.lookups[name].join(d), [n for n in self.lookups if n in wanted], self.df)
        return df.withColumns({n: c for n, (c, needs) in self.derived.items() if set(needs) <= wanted})

    def _conditions(self, chosen: dict[str, Sequence]) -> dict[str, Column]:
        return {name: F.coalesce(self.filters[name](values), F.lit(False))
                for name, values in chosen.items() if values}

    def where(self, chosen: dict[str, Sequence], *sorts: str) -> DataFrame:
        """Values of one filter are alternatives; filters add up."""
        return self._kept(chosen, self._with(*chosen, *sorts, shows=self.shows))

    def _kept(self, chosen: dict[str, Sequence], df: DataFrame) -> DataFrame:
        return reduce(DataFrame.filter, self._conditions(chosen).values(), df)

    def count(self, chosen: dict[str, Sequence]) -> DataFrame:
        return self._kept(chosen, self._with(*[n for n, v in chosen.items() if v])).agg(F.count(F.lit(1)).alias("total"))

    def page(self, chosen: dict[str, Sequence], sort: str, offset: int = 0, limit: int = 50) -> DataFrame:
        """Sorted by a named order, then by key; a top-n, never a full sort."""
        if not 1 <= limit <= MAX_PAGE:
            raise ValueError(f"limit is 1 to {MAX_PAGE}")
        return self.where(chosen, sort).orderBy(*self.sorts[sort], F.col(self.key)).offset(offset).limit(limit)

    def facets(self, chosen: dict[str, Sequence]) -> DataFrame:
        """facet, value, count: each facet within every other filter.

        One scan and one small shuffle for all facets: a row counts in a facet
        when no filter fails, or only the facet's own. The row is expanded
        into (facet, value) pairs and counted map-side.
        """
        conditions = self._conditions(chosen)
        misses = reduce(lambda a, b: a + b, [F.when(c, 0).otherwise(1) for c in conditions.values()], F.lit(0))
        pairs = []
        for name, facet in self.facets_of.items():
            own = F.when(conditions[name], 0).otherwise(1) if name in conditions else F.lit(0)
            tagged = self._tag(name, facet.values())
            pairs.append(F.when(F.col("_misses") - own == 0, tagged).otherwise(F.array().cast("array<struct<facet:string,value:string>>")))
        rows = self._with(*[n for n, v in chosen.items() if v], *self.facets_of).withColumn("_misses", misses).select(F.explode(F.concat(*pairs)).alias("_f")).select("_f.*")
        counted = rows.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))
        known = [(name, v) for name, facet in self.facets_of.items() for v in facet.zeros()]
        if not known:
            return counted
        spark = self.df.sparkSession
        zeros = lit_frame(spark, known, "facet string, value string").withColumn("count", F.lit(0).cast("long"))
        return counted.unionByName(zeros).groupBy("facet", "value").agg(F.sum("count").alias("count"))

    @staticmethod
    def _tag(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))
