"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one on each half of the unit vectors, span a grid of cells, and a vector lies in the cell of its halves'
nearest entries. A multi-sequence traversal visits the cells around a vector in the order of the sum of the halves' squared
distances. How many cells are visited follows from a target recall: sampled vectors get partners at exactly the least
cosine, in random directions, and the least number is taken at which a target share of the pairs is met by either side.
All that a cell holds is then verified by cosine in doubles.

Copies by the million: vectors of a cell, in packs of a bounded size, are first folded into balls around the mean of each
group of neighbours. Members within half the linking angle of that mean are linked with one another for certain, so a ball
is one item of the index, and two balls whose angle and radii decide the matter need no look at their members. Only balls
that may be linked in part are verified member by member, pack by pack. So a group of copies costs a share of a pack's
size, not the square of its own, and no list of pairs is made: counts and the edges of items leave a task.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, or is of another length than
most (the longer of two equally common ones), links with nothing and is its own component. Rows that repeat an id are
vectors of their own, each counts as another's partner, and a null id is nobody's name: a component's id is its smallest
one that is not null, or null. An empty table gives an empty one. Other columns are not read.

What can be missed: a link whose two sides both fail to visit the other's cell, one in 1 / (1 - TARGET) at the least
cosine by calibration, fewer above it. No partner, cell or candidate list is cut otherwise.

What reaches the driver: a sample of SAMPLE rows, the codebooks and two numbers for each cell of the grid, whose size MOST
bounds. Components are found on tables of item edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, settle
from .components import components
from .vector_codes import sound, usual_length

LEAST, TARGET = 0.9, 0.97
#: Vectors that fit the codebooks, and those of them that get partners; rounds of the fit.
SAMPLE, PARTNERS, FIT_ROUNDS, SEED = 20_000, 2_000, 8, 7
#: Vectors that a cell should hold if all were equally full; entries of a codebook at most.
PER_CELL, MOST = 128, 256
#: Members of a pack, visitors that meet a pack at once, and the margin of an angle's decision.
PACK, VISITORS, MARGIN = 1024, 32_768, 1e-9


def units(values: np.ndarray, dim: int) -> np.ndarray:
    """Unit rows in doubles; a row of zeros stays so."""
    x = values.astype(np.float64).reshape(-1, dim)
    top = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x = x / np.where(top > 0, top, 1)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def gaps(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1), 0)


def fitted(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """``n`` entries of a half by Lloyd rounds over the sample."""
    entries = x[rng.choice(len(x), n, replace=False)]
    for _ in range(FIT_ROUNDS):
        near = gaps(x, entries).argmin(1)
        size = np.bincount(near, minlength=n)
        sums = np.zeros_like(entries)
        np.add.at(sums, near, x)
        entries = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], entries)
    return entries


class Grid:
    """The two codebooks and how many cells a vector visits."""

    def __init__(self, left: np.ndarray, right: np.ndarray, visits: int = 1) -> None:
        self.left, self.right, self.visits, self.cells = left, right, visits, len(left) * len(right)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.left.shape[1]
        return gaps(x[:, :half], self.left), gaps(x[:, half:], self.right)

    def traverse(self, x: np.ndarray) -> np.ndarray:
        """(rows, visits) cells, the nearest first.

        Both halves' entries are put in order; the cell of ranks (i, j) has (i + 1) * (j + 1) cells before it or as near, so
        only ranks whose product does not pass the number of visits can be among them, and those are merged by their sums."""
        a, b = self.halves(x)
        n, m = min(self.visits, a.shape[1]), min(self.visits, b.shape[1])
        by_a, by_b = np.argsort(a, axis=1, kind="stable")[:, :n], np.argsort(b, axis=1, kind="stable")[:, :m]
        ranks = np.array([(i, j) for i in range(n) for j in range(m) if (i + 1) * (j + 1) <= self.visits])
        i, j = by_a[:, ranks[:, 0]], by_b[:, ranks[:, 1]]
        score = np.take_along_axis(a, i, 1) + np.take_along_axis(b, j, 1)
        order = np.argsort(score, axis=1, kind="stable")[:, : self.visits]
        return np.take_along_axis(i * len(self.right) + j, order, 1).astype(np.int32)

    def calibrated(self, x: np.ndarray, least: float, target: float, rng: np.random.Generator) -> Grid:
        """With as many visits as let a ``target`` share of pairs at the least cosine meet from either side."""
        z = rng.normal(size=x.shape)
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-300)
        y, rank = least * x + np.sqrt(1 - least * least) * z, []
        for at in range(0, len(x), 64):
            sides = [np.add(a[:, :, None], b[:, None, :]).reshape(len(a), -1) for a, b in (self.halves(v[at : at + 64]) for v in (x, y))]
            homes, i = [s.argmin(1) for s in sides], np.arange(len(sides[0]))
            rank.append(np.minimum(*[(s < s[i, homes[1 - k]][:, None]).sum(1) + 1 for k, s in enumerate(sides)]))
        visits = int(np.quantile(np.concatenate(rank), target, method="higher")) if rank else 1
        return Grid(self.left, self.right, visits)


def fit(rows: DataFrame, n: int, dim: int, least: float = LEAST, target: float = TARGET) -> Grid:
    """The grid for ``n`` vectors, from those whose rows have the smallest hashes."""
    share = F.pmod(F.xxhash64(F.lit(SEED), "row"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, 1.5 * SAMPLE / n)))
    picked = rows.where(share).orderBy(F.xxhash64(F.lit(SEED), "row"), "row").limit(SAMPLE).select("v").collect()
    x, rng = units(np.array([r["v"] for r in picked], dtype=np.float64), dim), np.random.default_rng(SEED)
    k, half = max(1, min(MOST, len(x), round((n / PER_CELL) ** 0.5))), dim // 2
    grid = Grid(fitted(x[:, :half], k, rng), fitted(x[:, half:], k, rng))
    return grid.calibrated(x[:PARTNERS], least, target, rng)


def balls_of(x: np.ndarray, angle: float) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(members, pivot, radius) of one pack: every row in one ball, alone or within half the angle of its ball's mean."""
    near = x @ x.T >= np.cos(angle)
    free, alone = np.ones(len(x), dtype=bool), near.sum(1) < 2
    for i in range(len(x)):
        if not free[i]:
            continue
        if not alone[i]:
            group = np.flatnonzero(near[i] & free)
            mean = x[group].sum(0)
            mean /= max(np.sqrt((mean * mean).sum()), 1e-300)
            away = np.arccos(np.clip(x[group] @ mean, -1, 1))
            inside = away <= angle / 2 - MARGIN
            if inside.sum() > 1 and inside[group == i].any():
                free[group[inside]] = False
                yield group[inside], mean, float(away[inside].max()) + MARGIN
                continue
        free[i] = False
        yield np.array([i]), x[i], 0.0


ITEMS = {
    "item": pa.int64(), "row": pa.list_(pa.int64()), "id": pa.list_(pa.int64()), "v": pa.binary(), "pivot": pa.binary(), "radius": pa.float64(), "size": pa.int32(), "least": pa.int64(), "visits": pa.list_(pa.int32()),
}
ITEMS_DDL = "item long, row array<long>, id array<long>, v binary, pivot binary, radius double, size int, least long, visits array<int>"


def placed(rows: DataFrame, grid: Grid, dim: int) -> DataFrame:
    """(row, id, v, cell): unit vectors as bytes, in order of their cells; a cell of any size goes to as many tasks as it
    needs, since its rows are dealt by range of (cell, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Grid(grid.left, grid.right, 1)
        for b in batches:
            if b.num_rows:
                x = units(b.column("v").flatten().to_numpy(zero_copy_only=False), dim)
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), pa.array([r.tobytes() for r in x], type=pa.binary()), pa.array(one.traverse(x)[:, 0])], names=["row", "id", "v", "cell"])

    cells = rows.select("row", "id", "v").mapInArrow(run, "row long, id long, v binary, cell int")
    return cells.repartitionByRange("cell", F.xxhash64("row")).sortWithinPartitions("cell", "row")


def folded(cells: DataFrame, grid: Grid, dim: int, angle: float) -> DataFrame:
    """Items: the balls of vectors sorted by cell, cut into packs of one cell."""

    def items(pack: list[tuple]) -> pa.RecordBatch:
        x, rows = np.frombuffer(b"".join(p[2] for p in pack)).reshape(len(pack), dim), []
        for members, pivot, radius in balls_of(x, angle):
            of, ids = [pack[k][0] for k in members], [pack[k][1] for k in members]
            rows.append((min(of), of, ids, x[members].tobytes(), pivot, radius, len(of), min((i for i in ids if i is not None), default=None)))
        visits = grid.traverse(np.stack([r[4] for r in rows])).tolist()
        cols = [*zip(*rows, strict=True), visits]
        cols[4] = [p.tobytes() for p in cols[4]]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, ITEMS.values(), strict=True)], names=[*ITEMS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, cell = [], None
        for b in batches:
            for row, i, v, c in zip(*(b.column(k).to_pylist() for k in ("row", "id", "v", "cell")), strict=True):
                if pack and (c != cell or len(pack) == PACK):
                    yield items(pack)
                    pack = []
                cell = c
                pack.append((row, i, v))
        if pack:
            yield items(pack)

    return cells.mapInArrow(run, ITEMS_DDL)


def by_cell(cells: DataFrame, n: int) -> np.ndarray:
    """Rows of each of the grid's ``n`` cells."""
    out = np.zeros(n, dtype=np.int64)
    for r in cells.groupBy("cell").count().collect():
        out[r["cell"]] = r["count"]
    return out


def meetings(items: DataFrame, grid: Grid) -> DataFrame:
    """Rows of members (role 0) and visitors (role 1) by (cell, block, slice).

    A cell's members are dealt over blocks and its visitors over slices, each of a bounded size, and every block meets every
    slice; directions go as single floats, what those cannot decide is verified in doubles later."""
    members = by_cell(items.select(F.col("visits")[0].alias("cell")), grid.cells)
    visitors = by_cell(items.select(F.explode("visits").alias("cell")), grid.cells)
    blocks, slices = -(-members // PACK), -(-visitors // VISITORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            item, visits = b.column("item").to_numpy(), np.array(b.column("visits").to_pylist(), dtype=np.int64)
            deal = (item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)
            home = visits[:, 0]
            pivots = pa.array([np.frombuffer(p).astype(np.float32).tobytes() for p in b.column("pivot").to_pylist()], type=pa.binary())

            def rows(at, cell, block, slice_, role):
                at = pa.array(at)
                cols = [pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(slice_.astype(np.int32)), pa.array(np.full(len(cell), role, dtype=np.int32))]
                held = [b.column("item"), pivots, b.column("radius"), b.column("size"), b.column("visits") if role == 0 else pa.array(visits[:, :1].tolist(), type=pa.list_(pa.int32()))]
                return pa.RecordBatch.from_arrays([*cols, *[c.take(at) for c in held]], names=MEETING)

            at, k = spread(slices[home])
            yield rows(at, home[at], deal[at] % blocks[home[at]], k, 0)
            cell, whose = visits.ravel(), np.repeat(np.arange(len(item)), visits.shape[1])
            for some in np.array_split(np.arange(len(cell)), max(1, len(cell) // 20_000)):
                at, k = spread(blocks[cell[some]])
                c, w = cell[some][at], whose[some][at]
                yield rows(w, c, k, deal[w] % slices[c], 1)

    return items.select("item", "pivot", "radius", "size", "visits").mapInArrow(run, MEETING_DDL)


MEETING = ["cell", "block", "slice", "role", "item", "pivot", "radius", "size", "visits"]
MEETING_DDL = "cell int, block int, slice int, role int, item long, pivot binary, radius double, size int, visits array<int>"


def spread(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, 0 .. times - 1) of each position, as often as ``times`` says."""
    at = np.repeat(np.arange(len(times)), times)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id reachable) for the ids of the links (a, b)."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        was = root.copy()
        np.minimum.at(root, root[x], root[y])
        np.minimum.at(root, root[y], root[x])
        root = root[root]
        if (root == was).all() and (root[x] == root[y]).all():
            return ids, ids[root]


class Meeting:
    """One block of a cell's members, and what its visitors found: counts and links by item, pairs left open."""

    def __init__(self, members: list[tuple], dim: int, angle: float) -> None:
        self.angle, self.dim = angle, dim
        self.item, self.x, self.radius, self.size, self.visits = self.columns(members)
        self.visits = np.array(self.visits, dtype=np.int64)
        self.n: dict[int, int] = {}
        self.links: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.open: list[tuple[np.ndarray, np.ndarray]] = []

    def columns(self, rows: list[tuple]):
        item, pivot, radius, size, visits = zip(*rows, strict=True)
        return np.array(item, dtype=np.int64), np.frombuffer(b"".join(pivot), dtype=np.float32).reshape(len(rows), self.dim).astype(np.float64), np.array(radius), np.array(size, dtype=np.int64), visits

    def meet(self, visitors: list[tuple]) -> None:
        item, x, radius, size, home = self.columns(visitors)
        reach = min(self.angle + radius.max() + self.radius.max() + 1e-4, np.pi)
        cos = x @ self.x.T
        q, m = np.nonzero(cos >= np.cos(reach))
        # a pair that meets in both cells is settled once, by the visit of its lesser item
        twice = (self.visits[m] == np.array([h[0] for h in home], dtype=np.int64)[q][:, None]).any(1)
        mine = (item[q] != self.item[m]) & ~(twice & (item[q] > self.item[m]))
        q, m = q[mine], m[mine]
        apart, both = np.arccos(np.clip(cos[q, m], -1, 1)), radius[q] + self.radius[m]
        sure, never = apart + both <= self.angle - 1e-5, apart - both > self.angle + 1e-5
        unsure = ~sure & ~never
        if unsure.any():
            self.open.append((item[q[unsure]], self.item[m[unsure]]))
        if sure.any():
            q, m = q[sure], m[sure]
            for ids, at, sizes in ((item, q, self.size[m]), (self.item, m, size[q])):
                found = np.bincount(at, weights=sizes, minlength=len(ids))
                for k in np.flatnonzero(found):
                    self.n[int(ids[k])] = self.n.get(int(ids[k]), 0) + int(found[k])
            self.links = local_roots(np.concatenate([self.links[0], item[q]]), np.concatenate([self.links[1], self.item[m]]))

    def found(self) -> Iterator[pa.RecordBatch]:
        a, b = self.links
        if len(a):
            yield verdicts(a, b, np.array([self.n[i] for i in a.tolist()], dtype=np.int64), False)
        for a, b in self.open:
            yield verdicts(a, b, np.zeros(len(a), dtype=np.int64), True)


def verdicts(a: np.ndarray, b: np.ndarray, n: np.ndarray, open_: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n), pa.array(np.full(len(a), open_))], names=["a", "b", "n", "open"])


def met(items: DataFrame, grid: Grid, dim: int, angle: float) -> DataFrame:
    """(a, b, n, open): items a with the n vectors of other items that they are linked to and one item of theirs, and pairs
    of items (open) that their directions and radii do not decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, visitors, meeting = None, [], [], None
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in MEETING), strict=True):
                if row[:3] != key or len(visitors) == PACK:
                    if visitors and (meeting or members):
                        meeting = meeting or Meeting(members, dim, angle)
                        meeting.meet(visitors)
                    visitors = []
                    if row[:3] != key:
                        if meeting:
                            yield from meeting.found()
                        key, members, meeting = row[:3], [], None
                (visitors if row[3] else members).append(row[4:])
        if visitors and (meeting or members):
            meeting = meeting or Meeting(members, dim, angle)
            meeting.meet(visitors)
        if meeting:
            yield from meeting.found()

    dealt = meetings(items, grid).repartition("cell", "block", "slice").sortWithinPartitions("cell", "block", "slice", "role", "item")
    return dealt.mapInArrow(run, "a long, b long, n long, open boolean")


#: Copies of a ball's members that its visitors are dealt over when members are verified one by one.
SALTS = 8


def verified(items: DataFrame, pairs: DataFrame, dim: int, least: float) -> DataFrame:
    """(a, b, n) of open pairs of items, in doubles: vectors (by row, b null) and the n of the other item that each is
    linked to, and the pairs of items (n null) with a link.

    The members of the smaller item visit those of the larger."""
    sizes = items.select("item", "size")
    one, two = (sizes.toDF(k, f"{k}_size") for k in ("a", "b"))
    turned = F.expr("a_size < b_size OR (a_size = b_size AND a < b)")
    pairs = pairs.join(one, "a").join(two, "b").select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("host"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("item"))
    packs = items.select("item", "row", "v")
    guests = pairs.join(packs, "item").select("host", F.pmod(F.hash("item"), F.lit(SALTS)).alias("salt"), F.lit(1).alias("role"), "item", "row", "v")
    hosts = packs.join(pairs.select(F.col("host").alias("item")).distinct(), "item", "left_semi")
    hosts = hosts.select(F.col("item").alias("host"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("role"), "item", "row", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host = None
        for b in batches:
            for role, item, row, v in zip(*(b.column(k).to_pylist() for k in ("role", "item", "row", "v")), strict=True):
                x = np.frombuffer(v).reshape(len(row), dim)
                if not role:
                    host = (item, row, x)
                    continue
                linked = x @ host[2].T >= least
                if linked.any():
                    a, n = np.array([*row, *host[1]]), np.concatenate([linked.sum(1), linked.sum(0)])
                    a, n = a[n > 0], n[n > 0]
                    yield pa.RecordBatch.from_arrays([pa.array([*a.tolist(), item]), pa.array([None] * len(a) + [host[0]], type=pa.int64()), pa.array([*n.tolist(), None], type=pa.int64())], names=["a", "b", "n"])

    return hosts.unionByName(guests).repartition("host", "salt").sortWithinPartitions("host", "salt", "role", "item").mapInArrow(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, least: float = LEAST, target: float = TARGET) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of the vectors of (vec_id, embedding), linked at a cosine of ``least`` or more."""
    if not 0 < least < 1:
        raise ValueError("least: over 0 and under 1")
    base = settle(vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v")).withColumn("row", F.monotonically_increasing_id()))
    fine = base.where(sound("v") & F.exists("v", lambda x: x != 0))
    dim = usual_length(fine, "v")
    good = F.coalesce(sound("v") & F.exists("v", lambda x: x != 0) & (F.size("v") == dim), F.lit(False))
    rows = base.where(good)
    n = rows.count() if dim else 0
    alone = base.where(~good).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if not n:
        return alone.withColumn("kept", F.lit(True))
    angle = float(np.arccos(least))
    grid = fit(rows, n, dim, least, target)
    items = settle(folded(placed(rows, grid, dim), grid, dim, angle))
    found = settle(met(items, grid, dim, angle))
    close = settle(verified(items, found.where("open").select("a", "b").distinct(), dim, least))
    links = found.where("NOT open AND a != b").select("a", "b").unionByName(close.where("n IS NULL").select("a", "b"))
    of_items = found.where("NOT open").groupBy(F.col("a").alias("item")).agg(F.sum("n").alias("by_item"))
    of_rows = close.where("n IS NOT NULL").groupBy(F.col("a").alias("row")).agg(F.sum("n").alias("by_row"))
    groups = components(links).select(F.col("v").alias("item"), F.col("c").alias("group"))
    named = settle(items.select("item", "least").join(groups, "item", "left").select("item", "least", F.coalesce("group", "item").alias("group")))
    names = named.groupBy("group").agg(F.min("least").alias("component_id"))
    members = items.select("item", "size", F.explode(F.arrays_zip("row", "id")).alias("m")).select("item", "size", F.col("m.row").alias("row"), F.col("m.id").alias("vec_id"))
    whole = members.join(named.select("item", "group").join(names, "group"), "item").join(of_items, "item", "left").join(of_rows, "row", "left")
    n_links = F.col("size") - 1 + F.coalesce("by_item", F.lit(0)) + F.coalesce("by_row", F.lit(0))
    out = settle(whole.select("vec_id", n_links.cast("long").alias("n_links"), "component_id").unionByName(alone))
    discard(base, items, found, close, named)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
