"""How many reports name each drug and reaction together, counted where the reports lie; counts alone are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.adapter import reachable

#: Reports that a task counts at a time, and rows of their crosses.
REPORTS, ROWS = 200_000, 4_000_000


def coded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(places, values) of a column: its different values, null first, and where in these each row's is."""
    found = pc.dictionary_encode(pa.concat_arrays([pa.nulls(1, column.type), column]), null_encoding="encode")
    return found.indices.to_numpy()[1:].astype(np.int64), found.dictionary


def widened(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(ends, places, values) of lists with a null put at the end of each."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    places, values = coded(lists.flatten())
    return np.cumsum(sizes + 1), np.insert(places, np.cumsum(sizes), 0), values


def tallied(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, how often each stands) of keys from 0 to under ``size``."""
    if size > 4 * len(keys):
        return np.unique(keys, return_counts=True)
    k = np.bincount(keys, minlength=1)
    return np.flatnonzero(k), k[k > 0]


def crosses(reports: pa.Table) -> Iterator[pa.RecordBatch]:
    """reports: columns of their own, then the lists drugs and pts. Counts of (columns, drug, pt), nulls as the margins."""
    col = {c: reports[c].chunk(0) for c in reports.column_names}
    by = list(col)[:-2]
    (d_ends, drug, drugs), (p_ends, pt, pts) = widened(col["drugs"]), widened(col["pts"])
    kind, kinds = np.zeros(reports.num_rows, np.int64), [np.zeros(1, np.int64) for _ in by]
    values = []
    for k, c in enumerate(by):
        places, found = coded(col[c])
        met, kind = np.unique(kind * len(found) + places, return_inverse=True)
        kinds = [x[met // len(found)] for x in kinds]
        kinds[k] = met % len(found)
        values.append(found)
    n_kinds = max(1, int(kind.max(initial=0)) + 1)
    of = np.repeat(np.arange(reports.num_rows), np.diff(d_ends, prepend=0))  # the report of each drug
    rows = np.diff(p_ends, prepend=0)[of]
    start = (p_ends - np.diff(p_ends, prepend=0))[of]
    upto = np.cumsum(rows)
    at = 0
    while at < len(of):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + ROWS, "right")))
        n = rows[at:end]
        left = kind[of[at:end]] * len(drugs) + drug[at:end]
        right = np.arange(n.sum()) + np.repeat(start[at:end] - (np.cumsum(n) - n), n)
        keys, k = tallied(np.repeat(left, n) * len(pts) + pt[right], n_kinds * len(drugs) * len(pts))
        left, right = keys // len(pts), keys % len(pts)
        group = left // len(drugs)
        cols = [v.take(pa.array(x[group])) for v, x in zip(values, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*cols, drugs.take(pa.array(left % len(drugs))), pts.take(pa.array(right)), pa.array(k)], names=[*by, "drug", "pt", "k"])
        at = end


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= REPORTS:
            yield from crosses(pa.Table.from_batches(held).combine_chunks())
            held, rows = [], 0
    if held:
        yield from crosses(pa.Table.from_batches(held).combine_chunks())


def cross_counts(reports: DataFrame, *by: str) -> DataFrame:
    """(by, drug, pt, k) of reports (by, drugs, pts), neither list with repeats or nulls: k reports name both. Without a drug
    (null) k counts the reports that name the reaction, without a reaction those that name the drug, without both all.

    One reading of the reports gives all margins: each list ends in a null, and crosses are counted in the tasks that read
    them, some million at a time."""
    reachable(reports.sparkSession)
    x = reports.select(*by, "drugs", "pts")
    types = ", ".join(f"`{c}` {x.schema[c].dataType.simpleString()}" for c in by)
    each = x.mapInArrow(counted, ", ".join(filter(None, [types, "drug string, pt string, k long"])))
    return each.groupBy(*by, "drug", "pt").agg(F.sum("k").alias("k"))
