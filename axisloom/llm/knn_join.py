"""Exact top-k search by inner product: a Voronoi join.

Vectors become integers, floor(64 x) of each component. A bounded sample of them, about the square
root of their number, serves as pivots; every vector belongs to the cell of its nearest pivot. A summary
keeps for each cell its count, its radius, its longest vector and the distances of the vectors that
are nearest to the pivot r. For a query q and a vector x at distance a from r,
``q.r - |q| a <= q.x <= q.r + |q| a`` and ``q.x <= |q| |x|``. So the nearest distances tell a score that
the k-th answer of q reaches for certain, and q goes only to cells whose upper bound gets there.

Queries of neighbouring cells form groups of bounded size, and cells are cut into blocks of bounded size, whatever
their share of the rows. Blocks of neighbouring cells form regions of bounded size. A task holds one region; each group
that needs one of its cells is sent there once, with the cells that each query needs. The groups pass by one after another,
the task returns the best k of each query, and the answers of the regions are merged. Matrices travel in
the smallest whole numbers that hold them. Nothing that grows with the table comes to the driver.

Where no bound excludes anything, as with directions spread evenly over many dimensions, this
compares every query with every vector, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axisloom.llm._io import drop_table, table
from axisloom.llm._worker import state

SCALE = 64
PIVOTS_LEAST, PIVOTS_MOST = 16, 1024
DATA_BLOCK = 2048
QUERY_BLOCK = 512
#: Blocks of a cell that stay together in a region, at most.
SLOT_BLOCKS = 8
#: Answers of regions that are merged into the best of a query group at a time.
GROUPS_KEPT = 64
#: Regions of a table that has blocks enough for them, and the bytes that one holds about at most; beyond them there are more regions.
REGIONS = 30
REGION_BYTES = 32 << 20
#: Nearest distances kept for a cell; where more would be needed to be certain, nothing is excluded.
NEAREST_MOST = 256
#: Products are exact in double precision while they stay below this.
EXACT = float(1 << 53)
EXACT_SINGLE = float(1 << 24)
#: How vectors are written, by the bytes of a component.
KINDS = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.float64}
NONE = np.iinfo(np.int64).min


def quantized(values) -> np.ndarray | None:
    """floor(64 x) of each component as doubles; None where the vector takes no part."""
    if values is None or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    if not np.isfinite(x).all():
        return None
    return np.floor(SCALE * x)


def _padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _compact(m: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest of ``KINDS`` that holds them."""
    most = np.abs(m).max(initial=0)
    return m.astype(next((kind for kind in (np.int8, np.int16, np.int32) if most <= np.iinfo(kind).max), np.float64))


def _matrix(raw: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, KINDS[len(raw) // (rows * width) if rows * width else 8]).reshape(rows, width)


def _products(q: np.ndarray, x: np.ndarray, q_most: float, x_most: float) -> np.ndarray:
    """Inner products as exact floats or, beyond the exact range of doubles, as :func:`_scores` has them.

    ``q_most``: the largest sum of a row's absolute values; ``x_most``: the largest absolute value.
    """
    bound = q_most * x_most
    if bound < EXACT:
        kind = np.float32 if bound < EXACT_SINGLE else np.float64
        return q.astype(kind) @ x.astype(kind).T
    return _scores(q.astype(np.float64), x.astype(np.float64))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond the exact range of doubles, Python integers held within 64 bits."""
    with np.errstate(over="ignore"):
        bound = np.abs(q).sum(axis=1).max(initial=0) * np.abs(x).max(initial=0)
    if bound < EXACT:
        return (q @ x.T).astype(np.int64)
    whole = [[int(v) for v in r] for r in x]
    low, high = -(1 << 63) + 1, (1 << 63) - 1
    return np.array([[min(max(sum(int(a) * b for a, b in zip(r, y, strict=True)), low), high) for y in whole] for r in q], np.int64)


def _ranked(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of each row, by score and then the smaller id; an id that comes twice counts once, with its better score."""
    by_id = np.lexsort((~scores, ids), axis=1)
    scores, ids = np.take_along_axis(scores, by_id, 1), np.take_along_axis(ids, by_id, 1)
    scores[:, 1:][ids[:, 1:] == ids[:, :-1]] = NONE
    best = np.lexsort((ids, ~scores), axis=1)[:, :k]
    return np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)


def local_top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the best k scores of a block and their ids, ties to the smaller id, its own id left out (``NONE`` where there are fewer).

    ``ids`` are in ascending order.
    """
    return _top(q_ids, _scores(q, x), ids, k)


def _top(q_ids: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    ids, first = np.unique(ids, return_index=True)
    if len(ids) < scores.shape[1]:
        scores = np.maximum.reduceat(scores, first, axis=1)
    scores[q_ids[:, None] == ids[None, :]] = NONE
    n, most = len(ids), min(k, len(ids))
    floor = np.partition(scores, n - most, axis=1)[:, n - most]
    row, col = np.nonzero(scores >= floor[:, None])
    order = np.lexsort((col, ~scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, col, place = row[place < k], col[place < k], place[place < k]
    out_s, out_i = np.full((len(q_ids), k), NONE), np.full((len(q_ids), k), -1, np.int64)
    out_s[row, place], out_i[row, place] = scores[row, col], ids[col]
    return out_s, out_i


class Best:
    """The best k of a block of queries, as blocks of vectors pass by.

    What may be among them waits until there is enough to rank; meanwhile the worst of the kept ones is the bar.
    """

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> None:
        self.q_ids, self.q, self.k = q_ids, q, k
        self.sums = np.abs(q.astype(np.float64)).sum(axis=1)
        self.scores, self.ids = np.full((len(q_ids), k), NONE), np.full((len(q_ids), k), -1, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def meet(self, these: np.ndarray, ids: np.ndarray, x: np.ndarray, most: float) -> None:
        """Some queries (rows) meet vectors with ascending ids, whose largest absolute component is ``most``."""
        width = max(self.q.shape[1], x.shape[1])
        with np.errstate(over="ignore"):
            scores = _products(_widened(self.q[these], width), _widened(x, width), self.sums[these].max(initial=0), most)
        n = scores.shape[1]
        at = np.flatnonzero(scores >= self.scores[these, -1:].astype(scores.dtype))
        if len(at) > 2 * self.k * len(these):
            s, j = _top(self.q_ids[these], scores.astype(np.int64), ids, self.k)
            self.scores[these], self.ids[these] = _ranked(np.hstack([self.scores[these], s]), np.hstack([self.ids[these], j]), self.k)
            return
        row, col = at // n, at % n
        other = self.q_ids[these[row]] != ids[col]
        self.waiting.append((these[row[other]], scores[row[other], col[other]].astype(np.int64), ids[col[other]]))
        if sum(len(w[0]) for w in self.waiting) > self.k * len(self.q_ids):
            self.rank()

    def rank(self) -> None:
        """Rank what waits."""
        if not self.waiting:
            return
        row, scores, ids = map(np.concatenate, zip(*self.waiting, strict=True))
        self.waiting.clear()
        if not len(row):
            return
        order = np.argsort(row, kind="stable")
        row, scores, ids = row[order], scores[order], ids[order]
        few, place = np.unique(row, return_inverse=True)
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        s, j = np.full((len(few), nth.max() + 1), NONE), np.full((len(few), nth.max() + 1), -1, np.int64)
        s[place, nth], j[place, nth] = scores, ids
        self.scores[few], self.ids[few] = _ranked(np.hstack([self.scores[few], s]), np.hstack([self.ids[few], j]), self.k)


def _pivots(vectors: DataFrame, most: int, count: int) -> np.ndarray:
    """A sample of at most ``most`` valid vectors out of ``count`` rows, by a hash.

    About four times as many rows compete, as each task sends the driver as many of them as it returns.
    """
    drawn = vectors.withColumn("h", F.xxhash64("id", "v"))
    if count > 8 * most:
        drawn = drawn.filter(F.pmod("h", F.lit(count)) < 4 * most)
    rows = drawn.orderBy("h", "id").limit(most * 2).collect()
    found = [v for r in rows if (v := quantized(r["v"])) is not None]
    found = found[:most] or [np.zeros(1)]
    return np.unique(_padded(found, max(map(len, found), default=1)), axis=0)


@dataclass
class Summary:
    """What is known of the cells: pivots, and for each counts of rows and queries, radius, longest vector and nearest distances."""

    pivots: np.ndarray
    rows: np.ndarray
    queries: np.ndarray
    radius: np.ndarray
    longest: np.ndarray
    nearest: np.ndarray  # filled up with infinity
    row_bytes: int = 8  # the longest row, as it is written

    def needed(self, q: np.ndarray, sure: int) -> np.ndarray:
        """For each query (row) whether a cell can hold answers, where ``sure`` rows are certain to hold enough of them."""
        width = max(q.shape[1], self.pivots.shape[1])
        q, p = _widened(q, width), _widened(self.pivots, width)
        out = np.ones((len(q), len(p)), bool)
        for at in range(0, len(q), 64):
            few = q[at : at + 64]
            with np.errstate(over="ignore", invalid="ignore"):
                norms = np.sqrt((few * few).sum(axis=1))[:, None]
                dots = few @ p.T
                slack = 1e-9 * (np.abs(dots) + norms * (self.radius + np.sqrt((p * p).sum(axis=1)))) + 1e-6
                high = np.minimum(dots + norms * self.radius, norms * self.longest) + slack
                low = ((dots - slack)[:, :, None] - norms[:, :, None] * self.nearest[None]).reshape(len(few), -1)
            low[np.isnan(low)] = -np.inf
            if sure > self.nearest.shape[1] or sure > low.shape[1]:
                continue
            reach = np.partition(low, low.shape[1] - sure, axis=1)[:, low.shape[1] - sure]
            out[at : at + 64] = ~(high < reach[:, None])  # what isn't a number is kept
        return out & (self.rows > 0)

    def chain(self) -> list[int]:
        """The cells in a chain of nearest neighbours."""
        left, chain = set(range(len(self.pivots))), []
        at = 0
        while left:
            chain.append(at)
            left.discard(at)
            rest = np.fromiter(left, int, len(left))
            if len(rest):
                with np.errstate(over="ignore", invalid="ignore"):
                    d = ((self.pivots[rest] - self.pivots[at]) ** 2).sum(axis=1)
                at = int(rest[np.where(np.isnan(d), np.inf, d).argmin()])
        return chain

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """For each cell the group of its queries and the number of parts that it needs.

        Groups follow the chain of cells and are cut where they are full.
        """
        chain = self.chain()
        group, held, number = np.zeros(len(chain), np.int32), 0, 0
        for c in chain:
            if held and held + self.queries[c] > QUERY_BLOCK:
                number, held = number + 1, 0
            group[c] = number
            held += self.queries[c]
        return group, np.maximum(1, -(-self.queries // QUERY_BLOCK)).astype(np.int32)

    def slots(self) -> np.ndarray:
        """How many slots the blocks of each cell are dealt over."""
        return np.maximum(1, -(-self.rows // (DATA_BLOCK * self.slot_blocks()))).astype(np.int32)

    def slot_blocks(self) -> int:
        """Blocks of a slot, so that it holds no more than a region may."""
        return max(1, min(SLOT_BLOCKS, REGION_BYTES // (self.row_bytes * DATA_BLOCK)))

    def regions(self) -> list[np.ndarray]:
        """For each cell the regions of its slots.

        Slots follow the chain of cells and are dealt out by the number of rows before them.
        """
        slots, total = self.slots(), int(self.rows.sum())
        most = max(1, min(max(DATA_BLOCK, -(-total // REGIONS)), REGION_BYTES // self.row_bytes))
        out, before = [np.zeros(0, np.int32)] * len(slots), 0.0
        for c in self.chain():
            each = self.rows[c] / slots[c]
            out[c] = ((before + each * (np.arange(slots[c]) + 0.5)) // most).astype(np.int32)
            before += self.rows[c]
        return out


CELLS = "id long, cell int, away double, norm double, size int, v binary"


def _valid(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of valid vectors and a matrix of the vectors as whole doubles, for each length that occurs."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    if flat.null_count == 0 and len(sizes) and (sizes == sizes[0]).all():
        m = flat.to_numpy(zero_copy_only=False).reshape(len(sizes), int(sizes[0]))
        fine = np.isfinite(m).all(axis=1)
        if fine.any():
            yield ids[fine], np.floor(SCALE * m[fine])
        return
    found: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, x in zip(ids.tolist(), lists.to_pylist(), strict=True):
        if (v := quantized(x)) is not None:
            found.setdefault(len(v), []).append((i, v))
    for width, rows in found.items():
        yield np.array([i for i, _ in rows], np.int64), _padded([v for _, v in rows], width)


def _assigned(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state("vectors")
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                for ids, m in _valid(batch.slice(at, 2048)):
                    width = max(pivots.shape[1], m.shape[1])
                    x, p = _widened(m, width), _widened(pivots, width)
                    with np.errstate(over="ignore", invalid="ignore"):
                        d = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * (x @ p.T)
                        cell = np.where(np.isnan(d), np.inf, d).argmin(axis=1)
                        away, norm = np.sqrt(((x - p[cell]) ** 2).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
                    away = np.where(np.isnan(away), np.inf, away)
                    cols = [pa.array(ids, pa.int64()), pa.array(cell, pa.int32()), pa.array(away), pa.array(norm), pa.array([m.shape[1]] * len(m), pa.int32()), pa.array([v.tobytes() for v in _compact(m)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["id", "cell", "away", "norm", "size", "v"])

    return vectors.mapInArrow(run, CELLS)


def _summary(rows: DataFrame, pivots: np.ndarray, asks, sure: int) -> Summary:
    """One row a cell, and its ``sure`` nearest distances, come to the driver."""
    n = len(pivots)
    nearest = np.full((n, sure if sure <= NEAREST_MOST else 0), np.inf)
    out = Summary(pivots, np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), nearest)
    for c, count, queries, radius, longest, most in rows.groupBy("cell").agg(F.count("*"), F.count_if(asks), F.max("away"), F.max("norm"), F.max(F.length("v"))).collect():
        out.rows[c], out.queries[c], out.radius[c], out.longest[c] = count, queries, radius, longest
        out.row_bytes = max(out.row_bytes, 8 + most)  # with its id
    if nearest.shape[1]:
        by = Window.partitionBy("cell").orderBy("away")
        few = rows.select("cell", "away", F.row_number().over(by).alias("nth")).filter(F.col("nth") <= sure)
        for c, aways in few.groupBy("cell").agg(F.sort_array(F.collect_list("away"))).collect():
            nearest[c, : len(aways)] = aways
    return out


def _data_blocks(rows: DataFrame, summary: Summary) -> DataFrame:
    """One row for each block of at most about ``DATA_BLOCK`` vectors of a cell: region, cell, ids and a matrix as bytes."""
    parts = F.array(*[F.lit(int(p)) for p in np.maximum(1, -(-summary.rows // DATA_BLOCK))])
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.get(parts, F.col("cell"))).cast("int"))
    regions, together = summary.regions(), summary.slot_blocks()

    def pack(t: pa.Table) -> pa.Table:
        ids, m = _packed(t)
        region = regions[t["cell"][0].as_py()][t["block"][0].as_py() // together]
        return pa.table({"region": pa.array([region], pa.int32()), "cell": t["cell"][:1], "width": pa.array([m.shape[1]], pa.int32()), "ids": pa.array([ids.tobytes()]), "m": pa.array([m.tobytes()])})

    packed = dealt.select("cell", "block", "id", "size", "v").groupBy("cell", "block").applyInArrow(pack, "region int, cell int, width int, ids binary, m binary")
    return table(packed, "data-blocks")


def _packed(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = t["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    sizes, vs = t["size"].to_numpy(), t["v"].to_pylist()
    m = np.zeros((len(ids), sizes.max()))
    for k, i in enumerate(order):
        m[k, : sizes[i]] = _matrix(vs[i], 1, int(sizes[i]))[0]
    return ids[order].astype("<i8"), _compact(m)


def _members(summary: Summary) -> list[np.ndarray]:
    """The cells of each region, in ascending order."""
    pairs = {(int(r), c) for c, found in enumerate(summary.regions()) if summary.rows[c] for r in found}
    return [np.array(sorted(c for of, c in pairs if of == r), int) for r in range(max((r for r, _ in pairs), default=0) + 1)]


def _query_blocks(asked: DataFrame, summary: Summary, sure: int) -> DataFrame:
    """One row for each block of queries: its name, ids, a matrix, and the regions that any query needs, with the cells there that each does (null: all)."""
    group, parts = summary.groups()
    members = _members(summary)
    place = lambda values: F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("cell"))
    dealt = asked.withColumn("group", place(group)).withColumn("part", F.pmod(F.xxhash64("id", "v"), place(parts)).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        ids, m = _packed(t)
        needed = summary.needed(m.astype(np.float64), sure)
        keys = []
        for r, cells in enumerate(members):
            if (few := needed[:, cells]).any():
                keys.append({"region": r, "needs": None if few.all() else np.packbits(few, axis=1).tobytes()})
        kinds = pa.list_(pa.struct([("region", pa.int32()), ("needs", pa.binary())]))
        return pa.table({"q_block": pa.array([f"{t['group'][0]}-{t['part'][0]}"]), "width": pa.array([m.shape[1]], pa.int32()), "ids": pa.array([ids.tobytes()]), "m": pa.array([m.tobytes()]), "keys": pa.array([keys], kinds)})

    packed = dealt.select("group", "part", "id", "size", "v").groupBy("group", "part").applyInArrow(pack, "q_block string, width int, ids binary, m binary, keys array<struct<region:int,needs:binary>>")
    return table(packed, "query-blocks")


class Region:
    """The vectors of a region, in stretches of whole blocks with at most about ``DATA_BLOCK`` rows."""

    def __init__(self, blocks: list[tuple[int, np.ndarray, np.ndarray]], cells: np.ndarray) -> None:
        self.stretches: list[list[tuple[int, np.ndarray, np.ndarray, float]]] = []
        self.whole: list[tuple[np.ndarray, np.ndarray, float]] = []
        held = 0
        for cell, ids, m in sorted(blocks, key=lambda b: b[0]):
            if not self.stretches or held + len(ids) > DATA_BLOCK:
                self.stretches.append([])
                held = 0
            held += len(ids)
            self.stretches[-1].append((int(np.searchsorted(cells, cell)), ids, m, float(np.abs(m.astype(np.float64)).max(initial=0))))
        for blocks_of in self.stretches:
            width = max(m.shape[1] for _, _, m, _ in blocks_of)
            ids = np.concatenate([ids for _, ids, _, _ in blocks_of])
            order = np.argsort(ids, kind="stable")
            self.whole.append((ids[order], np.concatenate([_widened(m, width) for _, _, m, _ in blocks_of])[order], max(most for *_, most in blocks_of)))

    def solve(self, best: Best, needs: np.ndarray | None) -> None:
        """``needs``: for each query (row) which cells of the region it needs; None: all do all."""
        every = np.arange(len(best.q_ids))
        for blocks, (ids, m, most) in zip(self.stretches, self.whole, strict=True):
            if needs is None or needs[:, [c for c, *_ in blocks]].all():
                best.meet(every, ids, m, most)
                continue
            for c, ids, m, most in blocks:
                if len(these := np.flatnonzero(needs[:, c])):
                    best.meet(these, ids, m, most)
        best.rank()


ANSWERS = "q_block string, q_ids binary, scores binary, ids binary"


def _solved(data: DataFrame, asked: DataFrame, members: list[np.ndarray], k: int) -> DataFrame:
    """One row for each block of queries and region that it needs: the best k of each query there, worse ones ``NONE``.

    A partition is a region; its data blocks come first, then the query blocks, one after another.
    """
    wanted = asked.select("q_block", "width", "ids", "m", F.explode("keys").alias("key")).select("key.region", F.lit(None).cast("int").alias("cell"), "width", "ids", "m", "q_block", "key.needs")
    both = data.select("region", "cell", "width", "ids", "m", F.lit(None).cast("string").alias("q_block"), F.lit(None).cast("binary").alias("needs")).unionByName(wanted)
    met = both.repartitionById(len(members), "region").sortWithinPartitions("region", F.col("q_block").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state("vectors")
        at, blocks, region = -1, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if r["region"] != at:
                    at, blocks, region = r["region"], [], None
                ids = np.frombuffer(r["ids"], "<i8")
                m = _matrix(r["m"], len(ids), r["width"])
                if r["q_block"] is None:
                    blocks.append((r["cell"], ids, m))
                    continue
                if region is None:
                    region, blocks = Region(blocks, members[at]), []
                best = Best(ids, m, k)
                needs = r["needs"] and np.unpackbits(np.frombuffer(r["needs"], np.uint8).reshape(len(ids), -1), axis=1, count=len(members[at])).astype(bool)
                region.solve(best, needs)
                yield pa.RecordBatch.from_arrays([pa.array([r["q_block"]]), *(pa.array([c.tobytes()], pa.binary()) for c in (ids, best.scores, best.ids))], names=["q_block", "q_ids", "scores", "ids"])

    return met.mapInArrow(run, ANSWERS)


def _merged(answers: DataFrame, k: int) -> DataFrame:
    """The best k of each query over all regions: query_id, id, score."""

    def merge(t: pa.Table) -> pa.Table:
        q_ids = np.frombuffer(t["q_ids"][0].as_py(), "<i8")
        scores, ids = np.full((len(q_ids), k), NONE), np.full((len(q_ids), k), -1, np.int64)
        for at in range(0, len(t), GROUPS_KEPT):
            few = [(np.frombuffer(t["scores"][n].as_py(), "<i8").reshape(-1, k), np.frombuffer(t["ids"][n].as_py(), "<i8").reshape(-1, k)) for n in range(at, min(at + GROUPS_KEPT, len(t)))]
            scores, ids = _ranked(np.hstack([scores, *(s for s, _ in few)]), np.hstack([ids, *(j for _, j in few)]), k)
        row, col = np.nonzero(scores != NONE)
        return pa.table({"query_id": pa.array(q_ids[row], pa.int64()), "id": pa.array(ids[row, col], pa.int64()), "score": pa.array(scores[row, col], pa.int64())})

    return answers.groupBy("q_block").applyInArrow(merge, "query_id long, id long, score long")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query its k best other vectors: ``query_id``, ``rank`` from 1, the id and ``score``.

    Queries are the rows whose id is divisible by ``every``; all rows with other ids are
    candidates. Ties go to the smaller id. Vectors that are null or hold null or non-finite
    components take no part, nor do null ids. Shorter vectors count as filled up with zeros.
    Rows that repeat an id are one candidate, which counts with its best score, and one query, which has
    the best scores of any of them. Scores beyond 64 bits are held at their bounds. With fewer than k
    candidates all are returned; an empty table gives an empty result; other columns are ignored, whatever their names. Ids
    must be whole numbers.
    """
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    count, repeats = slim.groupBy("id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(1))).first()
    if repeats > 1:
        slim = slim.dropDuplicates(["id", "v"])
        count = slim.count()
    pivots = _pivots(slim, min(PIVOTS_MOST, max(PIVOTS_LEAST, isqrt(count))), count)
    rows = table(_assigned(slim, pivots), "cells")
    asks = F.pmod("id", F.lit(every)) == 0
    sure = (k + 1) * repeats  # so many rows hold k ids other than the query's own
    summary = _summary(rows, pivots, asks, sure)
    data, asked = _data_blocks(rows, summary), _query_blocks(rows.filter(asks), summary, sure)
    drop_table(rows)
    local = _merged(_solved(data, asked, _members(summary), k), k)
    if repeats > 1:
        local = local.repartition("query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, max(list_inner_product(q.e, x.e)::BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 20
"""
