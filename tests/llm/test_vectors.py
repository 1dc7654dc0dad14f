"""Vector codes, the audit of filters and the index of vectors, against brute force and their SQL."""

from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from vigilake.llm import filter_audit, multi_index, queries, vector_codes
from test_operators import empty_dir, odd_dir, odd_rows, odd_vectors  # noqa: F401

VECTORS = "vec_id long, embedding array<float>, label int"


def made(n, dim, seed, groups=()):
    """Random unit vectors, then groups of (size, cosine to their base)."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for size, cos in groups:
        base = rng.normal(size=dim)
        base /= np.linalg.norm(base)
        z = rng.normal(size=(size, dim))
        z -= (z @ base)[:, None] * base
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        x = np.concatenate([x, cos * base + np.sqrt(1 - cos * cos) * z])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return x[rng.permutation(len(x))]


def frame(spark, x, labels=7):
    return spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x), "label": pa.array((np.arange(len(x)) % labels).astype(np.int32))}))


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_filter_audit", "op13_vector_dedup"])
def test_equal_to_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want, got = con.sql(queries.oracle_sql()[name]), queries.queries()[name](spark, sf_dir)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert Counter(map(tuple, got.select(*cols).collect())) == Counter(want.select(*cols).fetchall())


# ---- 11 codes


def plain_lloyd(x, parts, entries, rounds):
    """(codes, errors, codebooks) with Python integers, every part measured in every round."""
    x = [[[int(v) for v in p] for p in np.array_split(row, parts)] for row in x]
    books = [[x[k][p] for k in range(min(entries, len(x)))] for p in range(parts)]
    gap = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b, strict=True))
    near = lambda p: [min(range(len(books[p])), key=lambda k: gap(row[p], books[p][k])) for row in x]
    for _ in range(rounds):
        for p in range(parts):
            at = near(p)
            for k in range(len(books[p])):
                mine = [row[p] for row, a in zip(x, at, strict=True) if a == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    codes = [near(p) for p in range(parts)]
    return list(zip(*codes, strict=True)), [sum(gap(row[p], books[p][codes[p][k]]) for p in range(parts)) for k, row in enumerate(x)], books


def test_heap_lloyd_is_lloyd(spark):
    x = made(150, 12, 1, [(60, 0.97), (60, 0.9)])
    codes, errors, _ = plain_lloyd(np.floor(x.astype(float) * 1024).astype(int), 3, 16, 5)
    work = []
    got = vector_codes.compress(frame(spark, x).repartition(3), parts=3, entries=16, rounds=5, work=work).orderBy("vec_id").collect()
    assert [r["code"] for r in got] == ["".join(f"{k:02x}" for k in c) for c in codes]
    assert [r["error"] for r in got] == errors
    assert [r["label_error"] for r in got] == [sum(errors[k % 7 :: 7]) for k in range(len(x))]
    assert work[0] == 3 * len(x) and max(work[2:]) < work[0]  # later rounds leave parts alone


def test_heaps_pop_what_drift_violates():
    rng = np.random.default_rng(0)
    entry, key = rng.integers(0, 9, 1000), rng.normal(size=1000)
    drift = rng.normal(size=9) - 1
    got = vector_codes.Heaps(entry, key, 9).violated(drift)
    assert sorted(got) == np.flatnonzero(key <= drift[entry] + vector_codes.MARGIN).tolist()


def test_large_components_are_exact(spark):
    x = np.array([[3e10, -1.5, 1e12, 0], [3e10, 2.25, 1e12, 7], [-1e11, 0, 5, 5], [1e30, 0, 0, 0]], dtype=np.float64)
    whole = [[max(-(2**53), min(2**53, int(np.floor(v * 1024)))) for v in row] for row in x]
    codes, errors, _ = plain_lloyd(np.array(whole, dtype=object), 2, 2, 3)
    rows = spark.createDataFrame([(k, r.tolist(), 0) for k, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = vector_codes.compress(rows, parts=2, entries=2, rounds=3).orderBy("vec_id").collect()
    assert [r["code"] for r in got] == ["".join(f"{k:02x}" for k in c) for c in codes]
    assert [r["error"] for r in got] == [min(e, vector_codes.LONGEST) for e in errors]


def test_odd_vectors_have_codes(spark, odd_dir):  # noqa: F811
    got = queries.queries()["op11_vector_codes"](spark, odd_dir).collect()
    kept = [r for r in odd_vectors() if r[1] and len(r[1]) == 6 and all(v is not None and np.isfinite(v) for v in r[1])]
    assert Counter(r["vec_id"] for r in got) == Counter(r[0] for r in kept)
    assert all(r["error"] == 0 for r in got)  # as many entries as vectors, equal ones share the lower


# ---- 12 filters


def brute_audit(docs, labels, filters):
    """Filters applied one after the other, order by order, to lists of rows."""
    firsts = {}
    for i, t, *_ in docs:
        if i is not None:
            firsts[t or ""] = min(firsts.get(t or "", i), i)
    fails = [{k for k, f in filters.items() if f(t or "")} | ({"E"} if i is not None and i > firsts[t or ""] else set()) for i, t, *_ in docs]
    good, bad = ({i for i, q, x in labels if i is not None and v(q, x)} for v in (lambda q, x: q == 1, lambda q, x: x == 1))
    out = set()
    for part in {s or "" for _, _, _, s, *_ in docs}:
        rows = [(fails[k], d[0]) for k, d in enumerate(docs) if (d[3] or "") == part]
        removed = Counter()
        steps = []
        for order in permutations("ABCDE"):
            here = rows
            for step, f in enumerate(order, 1):
                lost, here = [r for r in here if f in r[0]], [r for r in here if f not in r[0]]
                removed[f] += len(lost)
                all_fail = sum(f in r[0] for r in rows)
                steps.append((part, "".join(order), step, len(here), len(lost), all_fail - len(lost), sum(r[0] == {f} for r in rows), sum(i in good for _, i in lost), sum(i in bad for _, i in lost), f))
        out |= {(*s[:-1], removed[s[-1]]) for s in steps}
    return out


def words(t):
    import re

    return re.findall("[^\x20\x09-\x0d]+", t)


FILTERS = {
    "A": lambda t: len(words(t)) < 50, "B": lambda t: 100 * len(set(words(t))) < 65 * len(words(t)),
    "C": lambda t: 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": lambda t: any(c in "#$%&*|" for c in t),
}


@pytest.mark.parametrize("seed", [0, 1])
def test_every_order_by_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    texts = ["", None, "ABC def", "x " * 80, " ".join(f"w{k}" for k in range(60)), " ".join(f"W{k}" for k in range(60)) + " #", "a\x0bb\x1cc $ é", "tie | " * 20]
    docs = [(None if rng.random() < 0.1 else int(rng.integers(0, 40)), texts[rng.integers(len(texts))], None, [None, "", "s", "t"][rng.integers(4)], 0) for _ in range(90)]
    labels = [(None if rng.random() < 0.1 else int(rng.integers(0, 40)), [0, 1, None][rng.integers(3)], [0, 1, None][rng.integers(3)]) for _ in range(40)]
    got = filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {tuple(r) for r in got.collect()} == brute_audit(docs, labels, FILTERS)


def test_odd_rows_are_audited(spark, odd_dir):  # noqa: F811
    got = queries.queries()["op12_filter_audit"](spark, odd_dir).collect()
    labels = [(2, 0, 1), (4, 1, 0), (5, None, None), (None, 1, 1), (6, 1, 0), (6, 1, 0)]
    assert {tuple(r) for r in got} == brute_audit(odd_rows(), labels, FILTERS) and len(got) == 600 * len({r[3] or "" for r in odd_rows()})


def test_other_filters_and_parts(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a b", "x"), (3, "c", "y")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels, {"S": "n_words < 2"}, "K", part=F.col("lang")).orderBy("part", "filter_order", "step").collect()
    assert [(r["part"], r["filter_order"], r["removed"], r["shapley"]) for r in got] == [("x", "KS", 1, 2), ("x", "KS", 0, 0), ("x", "SK", 0, 0), ("x", "SK", 1, 2), ("y", "KS", 0, 0), ("y", "KS", 1, 2), ("y", "SK", 1, 2), ("y", "SK", 0, 0)]
    with pytest.raises(ValueError):
        filter_audit.audit(docs, labels, {"K": "n_words < 2"}, "K")


# ---- 13 index


def brute_links(x, least=0.9):
    """(links, component) of every vector."""
    u = x.astype(np.float64)
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    near = (u @ u.T >= least) & ~np.eye(len(u), dtype=bool)
    root = np.arange(len(u))
    while True:
        low = np.minimum(root, np.where(near, root[None], len(u)).min(1))
        if (low == root).all():
            return near.sum(1), root
        root = low


@pytest.mark.parametrize("groups", [[(300, 0.99), (120, 0.975)], [(250, 0.955), (150, 0.945)]])
def test_links_by_brute_force(spark, monkeypatch, groups):
    """Tight groups are settled by balls, loose ones member by member; small packs cut both over many tasks."""
    monkeypatch.setattr(multi_index, "PACK", 64)
    monkeypatch.setattr(multi_index, "VISITORS", 128)
    x = made(900, 16, 5, groups)
    n, root = brute_links(x)
    got = multi_index.near_duplicates(frame(spark, x).repartition(4)).orderBy("vec_id").collect()
    links = np.array([r["n_links"] for r in got])
    assert (links <= n).all() and links.sum() >= 0.9 * n.sum()
    assert np.mean([r["component_id"] == c for r, c in zip(got, root, strict=True)]) > 0.95
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_whole_traversal_loses_nothing(spark, monkeypatch):
    """With every cell visited the result is exact, so each pair is settled once, whoever meets whom."""
    monkeypatch.setattr(multi_index, "PACK", 50)
    monkeypatch.setattr(multi_index, "PER_CELL", 40)
    monkeypatch.setattr(multi_index.Grid, "calibrated", lambda self, *_: multi_index.Grid(self.left, self.right, self.cells))
    x = made(300, 8, 9, [(120, 0.97), (80, 0.94)])
    n, root = brute_links(x)
    got = multi_index.near_duplicates(frame(spark, x).repartition(3)).orderBy("vec_id").collect()
    assert [r["n_links"] for r in got] == n.tolist() and [r["component_id"] for r in got] == root.tolist()


def test_pairs_may_meet_from_one_side(spark, monkeypatch):
    """With one visit a vector meets its own cell only; what is found is linked on both sides."""
    monkeypatch.setattr(multi_index, "PER_CELL", 40)
    monkeypatch.setattr(multi_index.Grid, "calibrated", lambda self, *_: multi_index.Grid(self.left, self.right, 2))
    x = made(400, 8, 2, [(60, 0.95)])
    n, _ = brute_links(x)
    got = np.array([r["n_links"] for r in multi_index.near_duplicates(frame(spark, x)).orderBy("vec_id").collect()])
    assert (got <= n).all() and got.sum() % 2 == 0 and got.sum() > 0


def test_traversal_is_nearest_first():
    rng = np.random.default_rng(0)
    grid = multi_index.Grid(rng.normal(size=(7, 3)), rng.normal(size=(5, 3)), 9)
    x = rng.normal(size=(40, 6))
    a, b = grid.halves(x)
    score = (a[:, :, None] + b[:, None, :]).reshape(40, -1)
    assert np.allclose(np.take_along_axis(score, grid.traverse(x).astype(int), 1), np.sort(score, axis=1)[:, :9])


def test_balls_link_all_their_members():
    x = multi_index.units(made(100, 16, 3, [(80, 0.98), (50, 0.95)]), 16)
    angle, seen = np.arccos(0.9), []
    for members, pivot, radius in multi_index.balls_of(x, angle):
        seen += members.tolist()
        assert (x[members] @ x[members].T >= 0.9 - 1e-9).all()
        assert (np.arccos(np.clip(x[members] @ pivot, -1, 1)) <= radius + 1e-6).all()
    assert sorted(seen) == list(range(len(x)))


def test_odd_vectors_have_components(spark, odd_dir):  # noqa: F811
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in queries.queries()["op13_vector_dedup"](spark, odd_dir).collect())
    alike = {(1, 3, 1, True): 1, (2, 3, 1, False): 2, (None, 3, 1, False): 1}
    alone = {(i, 0, i, True): 1 for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)}
    assert got == Counter(alike | alone)
