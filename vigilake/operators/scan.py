"""Ranks, running sums and running minima over families of any size, one of which may be the whole table.

A window over a large family is one task. Here rows are dealt by ranges of (family, order) and written; each range sums
itself up in one row a family it holds; what lies before or after a range in its family is carried from those few rows to
the ranges, which then scan themselves. A family within one range needs no carry, a family over many ranges is as many
tasks. Equal values that stand on both sides of a border are found among the first and last values of the ranges, of which
there are two at most for each range and family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import drop_settled, settle

PART = "__part"


class Ranges:
    """Rows in ranges of (family, order), each row with its place ``i`` in its family, from 1, and the family's size ``m``.

    ``by`` is the value whose ties matter, ascending, nulls first; ``ties`` are further columns that settle its order."""

    def __init__(self, rows: DataFrame, family: str, by: str, *ties: str, ranges: int | None = None) -> None:
        if taken := {PART, "i", "m"} & set(rows.columns):
            raise ValueError(f"columns of that name are there already: {sorted(taken)}")
        keys = [F.col(family), F.col(by), *map(F.col, ties)]
        dealt = rows.repartitionByRange(ranges, *keys) if ranges else rows.repartitionByRange(*keys)
        self.family, self.by, self.order = family, by, [by, *ties]
        self.held = [settle(dealt.withColumn(PART, F.spark_partition_id()))]
        base = self.held[0]
        sums = base.groupBy(PART, family).agg(F.count("*").alias("n"))
        before, whole = W.partitionBy(family).orderBy(PART).rowsBetween(W.unboundedPreceding, -1), W.partitionBy(family)
        carry = sums.select(PART, family, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"), F.sum("n").over(whole).alias("m"))
        local = F.row_number().over(W.partitionBy(PART, family).orderBy(*self.order))
        self.rows = self._keep(self._meet(base, carry).withColumn("i", local + F.col("__before")).drop("__before"))

    def _keep(self, rows: DataFrame) -> DataFrame:
        self.held.append(settle(rows))
        return self.held[-1]

    def _meet(self, rows: DataFrame, carry: DataFrame) -> DataFrame:
        """Rows with what was carried to their range; families may be null."""
        there = carry.select(F.col(PART).alias("__p"), F.col(self.family).alias("__f"), *[c for c in carry.columns if c not in (PART, self.family)])
        return rows.join(there, (F.col(PART) == F.col("__p")) & F.col(self.family).eqNullSafe(F.col("__f"))).drop("__p", "__f")

    def running(self, how: str, value: Column, into: str, backwards: bool = False) -> Ranges:
        """Adds the sum, min or max of ``value`` over the rows of the family up to each (from the last down, if ``backwards``)."""
        fold = {"sum": F.sum, "min": F.min, "max": F.max}[how]
        rows = self.rows.withColumn("__v", value)
        sums = rows.groupBy(PART, self.family).agg(fold("__v").alias("__s"))
        line = W.partitionBy(self.family).orderBy(F.desc(PART) if backwards else F.asc(PART)).rowsBetween(W.unboundedPreceding, -1)
        carry = sums.select(PART, self.family, fold("__s").over(line).alias("__c"))
        own = fold("__v").over(W.partitionBy(PART, self.family).orderBy(F.desc("i") if backwards else F.asc("i")).rowsBetween(W.unboundedPreceding, W.currentRow))
        both = {"sum": F.coalesce("__own", F.lit(0)) + F.coalesce("__c", F.lit(0)), "min": F.least("__own", "__c"), "max": F.greatest("__own", "__c")}[how]
        if how == "sum":
            both = F.when(F.col("__own").isNotNull() | F.col("__c").isNotNull(), both)
        met = self._meet(rows, carry).withColumn("__own", own).withColumn(into, both)
        self.rows = self._keep(met.drop("__v", "__c", "__own"))
        return self

    def _borders(self) -> DataFrame:
        """(family, value) of the first and last values of ranges: two rows for each range and family at most, and only of
        families that lie in several."""
        ends = self.rows.groupBy(PART, self.family).agg(F.min_by(self.by, "i").alias("lo"), F.max_by(self.by, "i").alias("hi"))
        several = ends.withColumn("__k", F.count("*").over(W.partitionBy(self.family))).where("__k > 1")
        return several.select(F.col(self.family).alias("__bf"), F.explode(F.array("lo", "hi")).alias("__bv")).distinct()

    def _over_ties(self, exprs: dict[str, tuple[str, Column]]) -> DataFrame:
        """Adds min or max aggregates over the rows of a family with an equal value, wherever their ranges end."""
        fold = {"min": F.min, "max": F.max}
        rows = self.rows.withColumns({f"__x{k}": x for k, (_, x) in enumerate(exprs.values())})
        # as many rows as two ranges have ends; equal values of a border meet in partial aggregates
        edge = F.broadcast(self._borders())
        same = F.col(self.family).eqNullSafe(F.col("__bf")) & F.col(self.by).eqNullSafe(F.col("__bv"))
        across = rows.join(edge, same).groupBy("__bf", "__bv").agg(*[fold[how](f"__x{k}").alias(f"__a{k}") for k, (how, _) in enumerate(exprs.values())])
        ties = W.partitionBy(PART, self.family, self.by)
        own = rows.withColumns({f"__o{k}": fold[how](f"__x{k}").over(ties) for k, (how, _) in enumerate(exprs.values())})
        met = own.join(F.broadcast(across), same, "left")
        out = met.withColumns({name: F.when(F.col("__bf").isNotNull() | F.col(f"__a{k}").isNotNull(), F.col(f"__a{k}")).otherwise(F.col(f"__o{k}")) for k, name in enumerate(exprs)})
        return out.drop("__bf", "__bv", *[f"__{c}{k}" for c in "xao" for k in range(len(exprs))])

    def over_ties(self, **exprs: tuple[str, Column]) -> Ranges:
        """Adds, for each name, the "min" or "max" of a column over the rows that tie with each."""
        self.rows = self._keep(self._over_ties(exprs))
        return self

    def done(self) -> DataFrame:
        """The rows, in a table of their own; what led to them is deleted."""
        out = self.held.pop()
        drop_settled(*self.held)
        self.held = [out]
        return out.drop(PART)
