"""What a merge changes in counts of distinct reports, counted where its rows lie: counts alone leave a task, and what a report
gains and loses in the index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.adapter import changes, coded, lists, reachable

ID, PT, DRUG = "safetyreportid", "reaction_pt", "drug_name"
#: What a count may be kept by, beside a report's id.
KEYS = ("sex", "age_stratum", DRUG, PT)


@dataclass(frozen=True)
class Count:
    """Distinct reports by ``keys``, of rows in which ``solid`` columns have text."""

    keys: tuple[str, ...]
    solid: tuple[str, ...] = ()


#: Rows that a task counts at a time, a report's together, and crosses of drugs and reactions, those of a report's drug together.
AT_ONCE, CROSSES = 20_000, 300_000
#: A change of a count, or the drugs that a report gains and loses.
OUT = pa.schema([("mart", pa.string()), *[(k, pa.string()) for k in KEYS], ("n", pa.int64()), (ID, pa.string()), ("gained", pa.list_(pa.string())), ("lost", pa.list_(pa.string()))])


def net(report: np.ndarray, key: np.ndarray, side: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(report, key, sign) of the keys from 0 to under ``size`` that a report names on one side alone: after (side 0, sign 1) or
    before (side 1, sign -1)."""
    told = np.unique((report * size + key) * 2 + side)
    other, alone = told[1:] >> 1 != told[:-1] >> 1, np.ones(len(told), bool)
    alone[1:] &= other
    alone[:-1] &= other
    told = told[alone]
    return (told >> 1) // size, (told >> 1) % size, 1 - 2 * (told & 1)


def summed(key: np.ndarray, sign: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, the sum of their signs), without sums of zero."""
    keys = np.arange(size)
    if size > 4 * len(key):
        keys, key = np.unique(key, return_inverse=True)
    n = np.bincount(key, sign, len(keys)).astype(np.int64)
    return keys[n != 0], n[n != 0]


class Faces:
    """Rows of whole reports, a report's beside each other, as what each said before the merge and says after it."""

    def __init__(self, rows: pa.Table) -> None:
        """rows: (safetyreportid, old, date, sex, age_stratum, drug_name, reaction_pt), the last two lists."""
        col = {c: rows[c].chunk(0) for c in rows.column_names}
        starts = np.append(0, changes(col[ID]))
        self.ids = col[ID].take(pa.array(starts))
        report = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
        place, dates = coded(col["date"])
        texts, rank = dates.to_pylist(), np.empty(len(dates), np.int64)
        rank[sorted(range(len(texts)), key=lambda k: (texts[k] is not None, texts[k] or ""))] = np.arange(len(texts))
        day, dated = rank[place], col["date"].is_valid().to_numpy(zero_copy_only=False)
        old = col["old"].to_numpy(zero_copy_only=False)
        asked = np.logical_or.reduceat(~old, starts)[report]
        after = np.flatnonzero(asked & dated & (day == np.maximum.reduceat(day, starts)[report]))
        row = np.append(after, before := np.flatnonzero(asked & old))
        self.side, self.report = np.repeat([0, 1], [len(after), len(before)]), report[row]
        self.codes, self.values, self.items = {}, {}, {}
        for c in ("sex", "age_stratum"):
            codes, self.values[c] = coded(col[c])
            self.codes[c] = codes[row]
        for c in (DRUG, PT):
            sizes = pc.fill_null(pc.list_value_length(col[c]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            codes, self.values[c] = coded(col[c].flatten())
            many = sizes[row]
            at = np.arange(many.sum()) + np.repeat((np.cumsum(sizes) - sizes)[row] - (np.cumsum(many) - many), many)
            self.items[c] = np.repeat(np.arange(len(row)), many), codes[at]  # (a face, one of its values), by face

    def listed(self, c: str, solid: bool) -> tuple[np.ndarray, np.ndarray]:
        face, code = self.items[c]
        if not solid:
            return face, code
        text = pc.fill_null(pc.not_equal(self.values[c], ""), False).to_numpy(zero_copy_only=False)
        return face[text[code]], code[text[code]]

    def named(self, count: Count) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(faces, the keys they name), a report's equal keys in one block; keys are numbers under :meth:`size`."""
        held = {c: self.listed(c, c in count.solid) for c in (DRUG, PT)}
        many = {c: np.bincount(face, minlength=len(self.report)) for c, (face, _) in held.items()}
        met = (many[DRUG] > 0) & (many[PT] > 0)
        key = np.zeros(len(self.report), np.int64)
        for c in ("sex", "age_stratum"):
            if c in count.keys:
                key = key * len(self.values[c]) + self.codes[c]
        asked = [c for c in (DRUG, PT) if c in count.keys]
        if asked:
            face, first = (x[met[held[asked[0]][0]]] for x in held[asked[0]])
            key = key[face] * len(self.values[asked[0]]) + first
        else:
            face = np.flatnonzero(met)
            key = key[face]
        if len(asked) < 2:
            yield face, key
            return
        at = np.lexsort((first, self.report[face]))
        face, key, first = face[at], key[at], first[at]
        report = self.report[face]
        ends = np.append(np.flatnonzero((report[1:] != report[:-1]) | (first[1:] != first[:-1])) + 1, len(face))
        upto = np.append(0, np.cumsum(many[PT][face]))
        start, codes, done = np.cumsum(many[PT]) - many[PT], held[PT][1], 0
        while done < len(face):
            k = np.searchsorted(upto[ends], upto[done] + CROSSES, "right") - 1
            end = int(ends[k]) if k >= 0 and ends[k] > done else int(ends[np.searchsorted(ends, done, "right")])
            n = many[PT][face[done:end]]
            right = np.arange(n.sum()) + np.repeat(start[face[done:end]] - (np.cumsum(n) - n), n)
            yield np.repeat(face[done:end], n), np.repeat(key[done:end], n) * len(self.values[PT]) + codes[right]
            done = end

    def size(self, count: Count) -> int:
        return int(np.prod([len(self.values[c]) for c in KEYS if c in count.keys], dtype=np.int64))

    def columns(self, count: Count, key: np.ndarray) -> dict[str, pa.Array]:
        out = {}
        for c in reversed([c for c in KEYS if c in count.keys]):
            out[c] = self.values[c].take(pa.array(key % len(self.values[c])))
            key = key // len(self.values[c])
        return out


def batch(mart: str, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    columns = {"mart": pa.repeat(mart, rows), **columns}
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in OUT], schema=OUT)


def told(counts: dict[str, Count], rows: pa.Table) -> Iterator[pa.RecordBatch]:
    faces = Faces(rows)
    for name, count in counts.items():
        size = faces.size(count)
        for face, key in faces.named(count):
            report, key, sign = net(faces.report[face], key, faces.side[face], size)
            if ID in count.keys:
                who, of = np.unique(report, return_inverse=True)
                drugs = faces.values[DRUG]
                sides = {to: lists(of[sign == s], drugs.take(pa.array(key[sign == s])), len(who)) for to, s in (("gained", 1), ("lost", -1))}
                yield batch(name, {ID: faces.ids.take(pa.array(who)), **sides})
            else:
                keys, n = summed(key, sign, size)
                yield batch(name, {**faces.columns(count, keys), "n": pa.array(n)})


def counted(counts: dict[str, Count], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """:func:`told` over the rows of a task in the order of their reports, whatever the batches' ends cut."""
    held, rows = [], 0
    for x in batches:
        if not x.num_rows:
            continue
        held.append(x)
        rows += x.num_rows
        if rows < AT_ONCE or x[ID][-1] == held[0][ID][0]:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        last = int(changes(whole[ID].chunk(0))[-1])
        yield from told(counts, whole.slice(0, last))
        held, rows = whole.slice(last).to_batches(), whole.num_rows - last
    if held:
        yield from told(counts, pa.Table.from_batches(held).combine_chunks())


def deltas(rows: DataFrame, counts: dict[str, Count]) -> DataFrame:
    """rows: (safetyreportid, old, date, sex, age_stratum, drug_name, reaction_pt), the last two lists: what reports say now
    (old) and what a merge brings. (mart, keys, n) for each task, and (mart, safetyreportid, gained, lost).

    A report's rows meet once, by id. It said what its old rows say, and will say what its rows at the last date say; a report
    that the merge does not bring is left out."""
    reachable(rows.sparkSession)
    dealt = rows.repartition(ID).sortWithinPartitions(ID)
    types = ", ".join(f"`{k}` string" for k in ("mart", *KEYS))
    return dealt.mapInArrow(partial(counted, counts), f"{types}, n long, `{ID}` string, gained array<string>, lost array<string>")


def summed_up(changed: DataFrame) -> DataFrame:
    """(mart, keys, n): the counts of all tasks of :func:`deltas`."""
    return changed.where(F.col(ID).isNull()).groupBy("mart", *KEYS).agg(F.sum("n").alias("n")).where("n != 0")
