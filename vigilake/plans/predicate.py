"""Strata as typed predicates: parsed once, bound to columns, never spliced into SQL."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schema import FACT

_TEXT = r"'(?:[^']|'')*'"
_VALUE = rf"(?:{_TEXT}|-?\d+(?:\.\d+)?)"
_TERM = re.compile(
    rf"""\s*(?P<col>[a-z_]+)\s*(?:
        (?P<null>IS\s+(?:NOT\s+)?NULL)
      | (?P<between>(?:NOT\s+)?BETWEEN)\s+(?P<lo>{_VALUE})\s+AND\s+(?P<hi>{_VALUE})
      | (?P<in>(?:NOT\s+)?IN)\s*\(\s*(?P<items>{_VALUE}(?:\s*,\s*{_VALUE})*)\s*\)
      | (?P<op>=|!=|<>|>=|<=|>|<|(?:NOT\s+)?LIKE\b)\s*(?P<value>{_VALUE}))\s*""",
    re.IGNORECASE | re.VERBOSE,
)
_WORD = re.compile(r"\s*(AND\b|OR\b|NOT\b|\(|\))\s*", re.IGNORECASE)


def literal(text: str):
    text = text.strip()
    if text.startswith("'"):
        return text[1:-1].replace("''", "'")
    return float(text) if "." in text else int(text)


@dataclass(frozen=True)
class Term:
    column: str
    op: str
    values: tuple

    def bind(self) -> Column:
        c, v = F.col(self.column), self.values
        one = v[0] if v else None
        return {
            "=": lambda: c == F.lit(one), "!=": lambda: c != F.lit(one), "<>": lambda: c != F.lit(one), ">=": lambda: c >= F.lit(one), "<=": lambda: c <= F.lit(one),
            ">": lambda: c > F.lit(one), "<": lambda: c < F.lit(one), "LIKE": lambda: c.like(one), "IN": lambda: c.isin(*v), "NOT IN": lambda: ~c.isin(*v),
            "BETWEEN": lambda: c.between(*v), "IS NULL": lambda: c.isNull(), "IS NOT NULL": lambda: c.isNotNull(),
            "NOT BETWEEN": lambda: ~c.between(*v), "NOT LIKE": lambda: ~c.like(one),
        }[self.op]()

    def columns(self) -> set[str]:
        return {self.column}


@dataclass(frozen=True)
class Group:
    """Conditions joined by AND or OR, or one that is negated."""

    op: str
    parts: tuple

    def bind(self) -> Column:
        first, *rest = [p.bind() for p in self.parts]
        if self.op == "NOT":
            return ~first
        for c in rest:
            first = first & c if self.op == "AND" else first | c
        return first

    def columns(self) -> set[str]:
        return set().union(*(p.columns() for p in self.parts))


class _Reader:
    """A condition read from the left: OR binds least, NOT most."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def word(self, *wanted: str) -> bool:
        m = _WORD.match(self.text, self.at)
        if m and m[1].upper() in wanted:
            self.at = m.end()
            return True
        return False

    def joined(self, op: str, part):
        parts = [part()]
        while self.word(op):
            parts.append(part())
        return parts[0] if len(parts) == 1 else Group(op, tuple(parts))

    def either(self):
        return self.joined("OR", self.both)

    def both(self):
        return self.joined("AND", self.one)

    def one(self):
        if self.word("NOT"):
            return Group("NOT", (self.one(),))
        if self.word("("):
            out = self.either()
            if not self.word(")"):
                raise ValueError(f"a bracket is not closed: {self.text[self.at :]!r}")
            return out
        return self.term()

    def term(self) -> Term:
        m = _TERM.match(self.text, self.at)
        if not m or m["col"].lower() not in FACT.fieldNames():
            raise ValueError(f"not a condition on the fact's columns: {self.text[self.at :]!r}")
        self.at = m.end()
        col, name = m["col"].lower(), lambda x: " ".join(m[x].upper().split())
        if m["null"]:
            return Term(col, name("null"), ())
        if m["between"]:
            return Term(col, name("between"), (literal(m["lo"]), literal(m["hi"])))
        if m["in"]:
            return Term(col, name("in"), tuple(literal(x) for x in re.findall(_VALUE, m["items"])))
        return Term(col, name("op"), (literal(m["value"]),))


@dataclass(frozen=True)
class Predicate:
    """A conjunction of conditions over the fact's columns. Terms on ``drug_name`` that stand in it by themselves ask for
    reports that have that drug too; within OR, NOT or brackets that hold them they are conditions on the row."""

    terms: tuple[Term | Group, ...] = ()

    @staticmethod
    def parse(text: str | None) -> Predicate:
        """Terms joined by AND, OR, NOT and brackets. Anything else, and any column outside the fact, is refused."""
        if text is None or not text.strip():
            return Predicate()
        reader = _Reader(text.strip())
        whole = reader.either()
        if reader.at != len(reader.text):
            raise ValueError(f"cannot be read: {reader.text[reader.at :]!r}")

        def flat(x) -> tuple:
            return tuple(z for y in x.parts for z in flat(y)) if isinstance(x, Group) and x.op == "AND" else (x,)

        return Predicate(flat(whole))

    def with_(self, column: str, op: str, *values) -> Predicate:
        return Predicate((*self.terms, Term(column, op, values)))

    def split(self) -> tuple[list[Term], list[Term]]:
        """(terms on co-medication or ids, terms on rows)"""
        other = [t for t in self.terms if isinstance(t, Term) and t.column == "drug_name" and t.op in ("=", "IN")]
        return other, [t for t in self.terms if t not in other]

    def route(self) -> str:
        """Which mart can answer: global, cubed, index, or a full scan."""
        if not self.terms:
            return "global"
        other, rows = self.split()
        columns = set().union(*(t.columns() for t in rows))
        if other or "safetyreportid" in columns:
            return "index"
        return "cubed" if columns <= {"sex", "age_stratum"} else "full"


def bound(terms: list[Term | Group]) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & t.bind()
    return out


# The patterns by which front-ends tell a route from a condition's text, letters in either case.
ID_LIST, ONE_DRUG, COLUMN = r"safetyreportid\s+IN\s*\(", r"\bdrug_name\s*=\s*'", r"\b([a-z_]+)\b\s*(?:=|IN\b|LIKE\b)"


def detect_route(where: str | None) -> str:
    """The route by the text of a condition alone, rule for rule as interactive front-ends expect it."""
    if where is None:
        return "global"
    if re.search(ID_LIST, where, re.IGNORECASE) or re.search(ONE_DRUG, where, re.IGNORECASE):
        return "index"
    names = {x.lower() for x in re.findall(COLUMN, where, re.IGNORECASE)}
    return "cubed" if names and names <= {"sex", "age_stratum"} else "full"


def stratum(sex: str | None = None, age: str | None = None, comedication: str | None = None) -> Predicate:
    """The predicate of the analysis form; "all" and blanks say nothing."""
    p = Predicate()
    if sex and sex.strip().lower() not in ("", "all"):
        p = p.with_("sex", "=", sex.strip().lower())
    if age:
        p = p.with_("age_stratum", "=", age)
    return p.with_("drug_name", "=", comedication) if comedication else p


def label(p: Predicate) -> str:
    """What a form shows for a stratum."""
    names = {"sex": "Sex", "age_stratum": "Age", "drug_name": "Co-med"}
    parts = [f"{names[t.column]}: {t.values[0] if t.column == 'drug_name' else str(t.values[0]).capitalize()}" for t in p.terms if isinstance(t, Term) and t.column in names and t.op == "="]
    return ", ".join(parts) or "None"
