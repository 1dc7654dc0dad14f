"""Which filter removes what: every order of a set of filters at once, by Shapley values of the multilinear extension.

A document's mask holds the filters that it fails. Masks are counted by part, so what is left of a part of any size is two
to the number of filters rows. From those counts comes the part's removal polynomial: with x_f the chance that filter f is
applied, the expected number of removed documents is R(x) = N - sum over masks of n_mask * product over f in mask of
(1 - x_f), a polynomial of degree one in each x. R at the corners of the cube gives what any prefix of an order removes;
the integral of dR/dx_f along the diagonal is the Shapley value of f, an exact fraction.

Defined results: a null text is an empty one; a null part is the empty string; rows that repeat an id count each; a null id
has no smaller id and is smaller than none, so it is never a duplicate; a document without label, or with null labels, is
neither good nor toxic, one with several labels is what any of them says; an empty table has no parts. Other columns,
whatever their names, are not read. Texts are compared by SHA-256.

Scale: texts are read once and leave as narrow rows, counted by (id, digest, part, mask) before anything is joined, so that
copies and repeated rows shrink on the map side. Digests are grouped for their smallest id by a partial aggregate; the joins
that follow have the id in their key, so that a text with a third of all copies is dealt over all tasks."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, settle

SPACE = r"[\x20\x09-\x0D]+"
#: Filters whose failing a text alone decides, over the columns ``text``, ``words`` (its list) and ``n_words``.
FILTERS = {
    "A": "n_words < 50",
    "B": "100L * size(array_distinct(words)) < 65L * n_words",
    "C": "100L * regexp_count(text, '[A-Z]') > 5L * char_length(text)",
    "D": "text RLIKE '[#$%&*|]'",
}
#: The filter that a text fails if a smaller id has the same one.
COPIES = "E"


def masks(docs: DataFrame, filters: dict[str, str], part: Column) -> DataFrame:
    """(id, digest, part, mask, n): documents by what they fail by themselves; bit k is the k-th filter."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.col("doc_id").alias("id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), text.alias("text"))
    read = read.withColumn("words", F.array_remove(F.split("text", SPACE, -1), "")).withColumn("n_words", F.size("words").cast("long"))
    mask = sum((F.when(F.expr(fails), 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    return read.select("id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "part", mask.alias("mask")).groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))


def counted(docs: DataFrame, labels: DataFrame, filters: dict[str, str], part: Column) -> DataFrame:
    """(part, mask, n, good, toxic), copies included as the last bit of the mask."""
    facts = settle(masks(docs, filters, part))
    firsts = facts.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).select("id", "digest", F.lit(True).alias("is_first"))
    known = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.bool_or(F.expr("quality = 1")), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.expr("toxic = 1")), F.lit(False)).alias("toxic")
    )
    named = facts.where("id IS NOT NULL").join(firsts, ["id", "digest"], "left").join(known, "id", "left")
    named = named.select("part", (F.col("mask") + F.when(F.col("is_first"), 0).otherwise(1 << len(filters))).alias("mask"), "n", "good", "toxic")
    nameless = facts.where("id IS NULL").select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    out = settle(named.unionByName(nameless).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("good"), F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0)).alias("toxic")
    ))
    discard(facts)
    return out


class Removal:
    """The removal polynomial of counts by mask: ``terms[S]`` is the coefficient of the product of x_f over f in S."""

    def __init__(self, counts: list[int]) -> None:
        self.size = len(counts).bit_length() - 1
        self.total = sum(counts)
        self.terms = [self.total - counts[0] - sum(counts[1:])]
        for s in range(1, len(counts)):
            holding = sum(n for m, n in enumerate(counts) if m & s == s)
            self.terms.append(holding if s.bit_count() % 2 else -holding)

    def corner(self, applied: int) -> int:
        """Documents removed when just the filters of ``applied`` run."""
        return sum(c for s, c in enumerate(self.terms) if s & applied == s)

    def shapley(self, f: int) -> Fraction:
        """The integral over t of dR/dx_f at x = (t, ..., t): a term of degree d gives its coefficient over d."""
        return sum((Fraction(c, s.bit_count()) for s, c in enumerate(self.terms) if s >> f & 1), Fraction(0))


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def every_order(counts: pd.DataFrame, letters: str) -> pd.DataFrame:
    """One part's rows: each order of the filters, each of its steps."""
    every = (1 << len(letters)) - 1
    polynomials = {}
    for name in ("n", "good", "toxic"):
        by_mask = [0] * (every + 1)
        for m, v in zip(counts["mask"], counts[name], strict=True):
            by_mask[m] += int(v)
        polynomials[name] = Removal(by_mask)
    corners = {name: [p.corner(s) for s in range(every + 1)] for name, p in polynomials.items()}
    gone, total = corners["n"], polynomials["n"].total
    shares = [polynomials["n"].shapley(f) * factorial(len(letters)) for f in range(len(letters))]
    assert all(x.denominator == 1 for x in shares)
    rows = []
    for order in permutations(range(len(letters))):
        name, before = "".join(letters[f] for f in order), 0
        for step, f in enumerate(order, 1):
            now = before | 1 << f
            lost = {k: c[now] - c[before] for k, c in corners.items()}
            rows.append((counts["part"].iloc[0], name, step, total - gone[now], lost["n"], gone[1 << f] - lost["n"], gone[every] - gone[every ^ 1 << f], lost["good"], lost["toxic"], int(shares[f])))
            before = now
    return pd.DataFrame(rows, columns=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]).astype({"step": np.int32})


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, copies: str = COPIES, part: Column | None = None) -> DataFrame:
    """Every order of ``filters`` and of the filter of copies, by part (``source`` if none is given).

    A part's group has at most two to the number of filters rows, whatever its documents are; those are few by their
    nature (the orders of six filters are 720), and more than seven are refused."""
    letters = "".join(filters) + copies
    if len(letters) > 7 or len(set(letters)) < len(letters) or any(len(k) != 1 for k in filters):
        raise ValueError("up to seven filters, each with a letter of its own")
    by_mask = counted(docs, labels, filters, F.col("source") if part is None else part)

    def orders(group: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        return every_order(group, letters)

    return by_mask.groupBy("part").applyInPandas(orders, SCHEMA)
