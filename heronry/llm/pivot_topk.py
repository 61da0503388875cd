"""Exact top-k search by inner product with pivot-table elimination.

Each vector's distances to many pivots are computed once and stored. For a query they bound every candidate's distance
from below, by the largest difference over the pivots, and with the norms its inner product from above. Candidates are
evaluated in the order of that bound until no bound reaches the k-th best score, so results are exact.

Blocks. Candidates are dealt by their nearest pivot (cells), small cells together and large ones by parts, so a block
holds neighbours and is of bounded size whatever repeats. A query first searches the block of its own cell; its k-th
score there, and each cell's interval of distances to every pivot, say which other blocks it must visit at all. Within
a block the candidates that the bounds leave are evaluated for many queries by one matrix product.

How much the bounds leave depends on the data: on vectors without clusters in many dimensions nearly all distances
are alike and nearly all candidates must be evaluated, by any pivots.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm.common import stored

#: Pivots of each dimension (collected and broadcast), and the sampled vectors that they are chosen from.
PIVOTS, PIVOT_SAMPLE = 48, 960
#: Rows of a block at most, and rows under which candidates are not dealt further to have a block for every core.
QUERY_BLOCK, CANDIDATE_BLOCK, LEAST_BLOCK = 8192, 16384, 1024
#: Queries whose bounds are computed together, and candidates of the first round in bound order.
STRIP, FIRST = 32, 64


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products of all pairs: in doubles where they are exact, else in Python's integers."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
    if most < 2**53:
        return np.rint(queries @ vectors.T)
    whole = [[int(x) for x in v] for v in vectors]
    return np.array([[sum(int(x) * y for x, y in zip(q, v)) for v in whole] for q in queries], dtype=object)


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((vectors - p) ** 2).sum(axis=1)) for p in pivots], axis=1) if len(pivots) else np.zeros((len(vectors), 0))


def far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots out of a sample: each one farthest from those chosen before it; no vector twice."""
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _upper(queries: np.ndarray, query_far: np.ndarray, norms: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Upper bounds of all inner products; ``far`` has a row for each pivot. Rounding never hides a candidate."""
    low = np.zeros((len(queries), len(norms)), np.float32)
    other = np.empty_like(low)
    for p, row in enumerate(far):
        np.subtract(row[None, :], query_far[:, p, None], out=other)
        np.maximum(low, np.abs(other, out=other), out=low)
    margin = 1e-6 * max(float(query_far.max(initial=0)), float(far.max(initial=0)))
    own = (queries * queries).sum(axis=1)[:, None]
    bound = np.maximum(low.astype(float) - margin, 0)
    return (own + norms[None, :]) * (0.5 + 1e-9) - bound * bound / 2 + 1e-6


def search_block(queries: np.ndarray, query_far: np.ndarray, own: np.ndarray, least: np.ndarray, ids: np.ndarray, vectors: np.ndarray, far: np.ndarray, k: int) -> tuple[list[list[tuple[int, int]]], int]:
    """For each query the k best (id, score) of a block, those of at least its ``least`` score, and the evaluated pairs.

    Candidates are in order of their ids, which decides ties; ``own`` is the query's place among them, or -1.
    """
    norms = (vectors * vectors).sum(axis=1)
    pivots_first = np.ascontiguousarray(far.T.astype(np.float32))
    found: list[list[tuple[int, int]]] = []
    evaluated = 0
    for lo in range(0, len(queries), STRIP):
        q, least_here, own_here = queries[lo : lo + STRIP], least[lo : lo + STRIP], own[lo : lo + STRIP]
        upper = _upper(q, query_far[lo : lo + STRIP].astype(np.float32), norms, pivots_first)
        itself = np.flatnonzero(own_here >= 0)
        upper[itself, own_here[itself]] = -np.inf
        # The candidates of the highest bounds first: their k-th score says which of the others can matter.
        n = min(FIRST, len(ids))
        first = np.sort(np.argpartition(-upper, n - 1, axis=1)[:, :n], axis=1)
        best: list[tuple[np.ndarray, np.ndarray]] = []
        kth = np.full(len(q), -np.inf)
        for i, places in enumerate(first):
            places = places[(upper[i, places] >= least_here[i]) & (places != own_here[i])]
            scores = _products(q[i : i + 1], vectors[places])[0]
            evaluated += len(places)
            best.append((places, scores))
            kth[i] = max(least_here[i], np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf)
        alive = upper >= kth[:, None]
        alive[itself, own_here[itself]] = False
        np.put_along_axis(alive, first, False, axis=1)
        columns = np.flatnonzero(alive.any(axis=0))
        if len(columns):
            alive = alive[:, columns]
            scores = _products(q, vectors[columns])
            evaluated += int(alive.sum())
            alive &= scores >= kth[:, None]
        for i, (places, own_scores) in enumerate(best):
            if len(columns):
                more = np.flatnonzero(alive[i])
                places, own_scores = np.concatenate((places, columns[more])), np.concatenate((own_scores, scores[i, more]))
            enough = own_scores >= kth[i]
            places, own_scores = places[enough], own_scores[enough]
            order = np.lexsort((places, -own_scores))[:k]
            found.append([(int(ids[places[j]]), int(own_scores[j])) for j in order])
    return found, evaluated


def _usable(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = df.where(F.col(id_col).isNotNull() & v.isNotNull() & ~bad)
    return whole.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("v")).withColumn("dim", F.size("v"))


def _packed(block: np.ndarray) -> list[bytes]:
    """Whole numbers of each row in as few bytes as the block needs."""
    most = float(np.abs(block).max(initial=0))
    kind = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64
    return [row.tobytes() for row in block.astype(kind)]


def _vectors(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    rows = column.to_pylist()
    kinds = {2 * dim: np.int16, 4 * dim: np.int32, 8 * dim: np.float64}
    if len({len(r) for r in rows}) < 2 and rows:
        return np.frombuffer(b"".join(rows), kinds[len(rows[0])]).reshape(len(rows), dim).astype(float)
    return np.array([np.frombuffer(r, kinds[len(r)]).astype(float) for r in rows]).reshape(len(rows), dim)


def _far(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1 if rows and rows[0] else 0)


def _pivots(vectors: DataFrame, n: int, pivots: int) -> dict[int, np.ndarray]:
    """Pivots by dimension out of at most PIVOT_SAMPLE vectors of each, taken by hash of the whole row."""
    h = F.xxhash64("id", "v", F.lit(7))
    sample = vectors.select("dim", "v", h.alias("h")).where(F.pmod("h", F.lit(max(1, n // PIVOT_SAMPLE))) == 0)
    ranked = sample.withColumn("r", F.row_number().over(Window.partitionBy("dim").orderBy("h"))).where(F.col("r") <= PIVOT_SAMPLE)
    found: dict[int, list] = {}
    for dim, v in ranked.select("dim", "v").collect():
        found.setdefault(dim, []).append(v)
    return {dim: far_apart(np.array(sorted(rows), float).reshape(len(rows), dim), pivots) for dim, rows in found.items()}


KNOWN = "id long, dim int, cell int, v binary, far binary"


def _with_distances(vectors: DataFrame, chosen: dict[int, np.ndarray]) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(chosen)  # at most PIVOTS a dimension

    def task(batches):
        for batch in batches:
            dims, rows = batch.column("dim").to_numpy(), batch.column("v").to_pylist()
            cell, v, far = np.zeros(len(rows), np.int32), [b""] * len(rows), [b""] * len(rows)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                block = np.array([rows[i] for i in at], float).reshape(len(at), dim)
                table = distances(block, shared.value.get(dim, np.zeros((0, dim)))).astype(np.float32)
                if table.shape[1]:
                    cell[at] = table.argmin(axis=1)
                for i, a, b in zip(at, _packed(block), table):
                    v[i], far[i] = a, b.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("dim"), pa.array(cell), pa.array(v, pa.binary()), pa.array(far, pa.binary())], names=["id", "dim", "cell", "v", "far"])

    return vectors.select("id", "v", "dim").mapInArrow(task, KNOWN)


def _cells(known: DataFrame) -> dict[int, dict[int, tuple]]:
    """By dimension and cell: rows, and the least and largest distance to every pivot, and square of the norm.

    The driver gets (pivots + 1) rows a cell.
    """

    def task(batches):
        seen: dict[tuple[int, int], list] = {}
        for batch in batches:
            dims, cells = batch.column("dim").to_numpy(), batch.column("cell").to_numpy()
            far, v = batch.column("far").to_pylist(), batch.column("v").to_pylist()
            for dim, cell in sorted(set(zip(dims.tolist(), cells.tolist()))):
                at = np.flatnonzero((dims == dim) & (cells == cell))
                table = np.stack([np.frombuffer(far[i], np.float32) for i in at])
                block = _vectors(pa.chunked_array([pa.array([v[i] for i in at], pa.binary())]), dim)
                wide = np.column_stack((table, (block * block).sum(axis=1)))
                old = seen.setdefault((dim, cell), [0, np.full(wide.shape[1], np.inf), np.full(wide.shape[1], -np.inf)])
                old[0] += len(at)
                old[1], old[2] = np.minimum(old[1], wide.min(axis=0)), np.maximum(old[2], wide.max(axis=0))
        rows = [(d, c, p, n, float(a), float(b)) for (d, c), (n, low, high) in seen.items() for p, (a, b) in enumerate(zip(low, high))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64()))], names=["dim", "cell", "p", "n", "low", "high"])

    partial = known.select("dim", "cell", "v", "far").mapInArrow(task, "dim int, cell int, p int, n long, low double, high double")
    rows = partial.groupBy("dim", "cell", "p").agg(F.sum("n"), F.min("low"), F.max("high")).collect()
    found: dict[int, dict[int, tuple]] = {}
    for dim, cell, _, n, low, high in sorted(map(tuple, rows)):
        _, lows, highs = found.setdefault(dim, {}).setdefault(cell, (n, [], []))
        lows.append(low)
        highs.append(high)
    return found


def _blocks(cells: dict[int, dict[int, tuple]], aim: int) -> dict[int, tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By dimension: cluster of each cell, and for each cluster its first block, its parts and its intervals.

    A cluster is several small cells, in order of their likeness, or one large cell in parts of ``aim`` rows.
    """
    out, block = {}, 0
    for dim in sorted(cells):
        own, groups = cells[dim], []
        left = sorted(own)
        at = left[0]
        while left:
            left.remove(at)
            if groups and sum(own[c][0] for c in groups[-1]) + own[at][0] <= aim:
                groups[-1].append(at)
            else:
                groups.append([at])
            here = np.array(own[at][1])
            at = min(left, key=lambda c: float(np.abs(np.array(own[c][1]) - here).sum()), default=None)
        parts = np.array([-(-sum(own[c][0] for c in g) // aim) for g in groups])
        first = block + np.concatenate(([0], np.cumsum(parts)[:-1]))
        block += int(parts.sum())
        low = np.array([np.min([own[c][1] for c in g], axis=0) for g in groups])
        high = np.array([np.max([own[c][2] for c in g], axis=0) for g in groups])
        out[dim] = ({c: i for i, g in enumerate(groups) for c in g}, first, parts, low, high)
    return out


def reachable(query: np.ndarray, far: np.ndarray, least: float, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which clusters may hold a candidate with a score of ``least`` or more; the last interval is of squared norms."""
    gap = np.maximum(np.maximum(low[:, :-1] - far, far - high[:, :-1]), 0).max(axis=1, initial=0)
    gap = np.maximum(gap - 1e-6 * max(float(far.max(initial=0)), float(high[:, :-1].max(initial=0))), 0)
    own = float(query @ query)
    return (own + high[:, -1]) * (0.5 + 1e-9) - gap * gap / 2 + 1e-6 >= least


def top_k(df: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query.

    Components x become floor(scale * x). Queries are the rows whose id is divisible by ``every``; candidates are
    all rows but the query's own, of as many components. Ties go to the smaller id. Rows that repeat an id, or are
    alike, take part each: each is a candidate of its own and, as a query, has k ranks of its own. Rows with a null
    id, a null vector, or a null or non-finite component take no part; an empty table gives no rows. Scores beyond
    64 bits raise an error. Columns other than the two named are not read, so their names cannot clash.

    Blocks are dealt by a number that each row gets in a stored table, so neither a hot vector nor a repeated id makes
    a large block. The driver sees the pivots of each dimension and (pivots + 1)^2 numbers about their cells.
    """
    spark = df.sparkSession
    vectors = _usable(df, id_col, vector_col, scale)
    asked = F.col("id") % every == 0
    size = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(asked, 1).otherwise(0)).alias("q")).collect()
    n = max((r["n"] for r in size), default=0)
    known = stored(_with_distances(vectors, _pivots(vectors, n, pivots)).withColumn("row", F.monotonically_increasing_id()), "pivot-table")
    cores = 2 * spark.sparkContext.defaultParallelism
    aim = min(CANDIDATE_BLOCK, max(-(-n // cores), min(LEAST_BLOCK, CANDIDATE_BLOCK)))
    query_blocks = {r["dim"]: max(1, math.ceil(r["q"] / QUERY_BLOCK)) for r in size}
    where = spark.sparkContext.broadcast((_blocks(_cells(known), aim), query_blocks))  # pivots^2 numbers a dimension

    def block_of(dims, cells, rows) -> list[int]:
        plan = where.value[0]
        out = []
        for dim, cell, row in zip(dims, cells, rows):
            cluster, first, parts, *_ = plan[dim]
            i = cluster[cell]
            out.append(int(first[i] + (row * 0x9E3779B97F4A7C15 >> 32) % int(parts[i])))
        return out

    def homes(batches):
        """Each row with its block."""
        for batch in batches:
            dims, cells, rows = (batch.column(c).to_pylist() for c in ("dim", "cell", "row"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block_of(dims, cells, rows), pa.int64())], names=[*batch.schema.names, "block"])

    def visits(batches):
        """Each query with the blocks that it must visit but its own, where it has been."""
        plan, query_blocks = where.value
        for batch in batches:
            out = []
            for i, (row, dim, v, far, kth, home) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "dim", "v", "far", "kth", "block")))):
                _, first, parts, low, high = plan[dim]
                q, d = _vectors(pa.chunked_array([[v]]), dim)[0], np.frombuffer(far, np.float32).astype(float)
                for c in np.flatnonzero(reachable(q, d, -np.inf if kth is None else kth, low, high)):
                    out += [(i, b, row % query_blocks[dim]) for b in range(int(first[c]), int(first[c] + parts[c])) if b != home]
            at, block, part = zip(*out) if out else ((), (), ())
            taken = batch.drop_columns(["block"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(block, pa.int64()), pa.array(part, pa.int64())], names=[*taken.schema.names, "block", "part"])

    def searched(left: pa.Table, right: pa.Table) -> tuple[list, list]:
        dim = right.column("c_dim")[0].as_py()
        right = right.sort_by([("c_id", "ascending"), ("c_row", "ascending")])
        rows = right.column("c_row").to_numpy()
        by_row = np.argsort(rows)
        mine = left.column("row").to_numpy()
        at = by_row[np.minimum(np.searchsorted(rows, mine, sorter=by_row), len(rows) - 1)]
        own = np.where(rows[at] == mine, at, -1)
        least = np.array([-np.inf if x is None else float(x) for x in left.column("kth").to_pylist()])
        found, _ = search_block(_vectors(left.column("v"), dim), _far(left.column("far")), own, least, right.column("c_id").to_numpy(), _vectors(right.column("c_v"), dim), _far(right.column("c_far")), k)
        return [[i for i, _ in rows] for rows in found], [[s for _, s in rows] for rows in found]

    def at_home(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, scores = searched(left, right) if left.num_rows else ([], [])
        kth = [s[-1] if len(s) == k else None for s in scores]
        return pa.table([left.column(c) for c in ("row", "id", "dim", "v", "far", "block")] + [pa.array(kth, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.int64()))], names=["row", "id", "dim", "v", "far", "block", "kth", "ids", "scores"])

    def away(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, scores = searched(left, right) if left.num_rows and right.num_rows else ([], [])
        some = [i for i, found in enumerate(ids) if found]
        return pa.table([left.column("row").take(pa.array(some, pa.int64())), left.column("id").take(pa.array(some, pa.int64())), pa.array([ids[i] for i in some], pa.list_(pa.int64())), pa.array([scores[i] for i in some], pa.list_(pa.int64()))], names=["row", "id", "ids", "scores"])

    placed = known.select("row", "id", "dim", "cell", "v", "far").mapInArrow(homes, "row long, id long, dim int, cell int, v binary, far binary, block long")
    candidates = placed.select(F.col("block").alias("c_block"), F.col("row").alias("c_row"), F.col("id").alias("c_id"), F.col("dim").alias("c_dim"), F.col("v").alias("c_v"), F.col("far").alias("c_far"))
    queries = placed.where(asked).select("row", "id", "dim", "v", "far", "block", F.lit(None).cast("long").alias("kth"))
    first = queries.groupBy("block").cogroup(candidates.groupBy("c_block")).applyInArrow(at_home, "row long, id long, dim int, v binary, far binary, block long, kth long, ids array<long>, scores array<long>")
    first = stored(first, "own-blocks")

    travelling = first.select("row", "id", "dim", "v", "far", "kth", "block").mapInArrow(visits, "row long, id long, dim int, v binary, far binary, kth long, block long, part long")
    copies = F.create_map(*[F.lit(x) for d, b in query_blocks.items() for x in (d, b)]) if query_blocks else None
    parts = F.coalesce(copies[F.col("c_dim")], F.lit(1)) if copies is not None else F.lit(1)
    dealt = candidates.withColumn("c_part", F.explode(F.sequence(F.lit(0), parts - 1).cast("array<long>")))
    rest = travelling.groupBy("block", "part").cogroup(dealt.groupBy("c_block", "c_part")).applyInArrow(away, "row long, id long, ids array<long>, scores array<long>")

    pairs = F.explode(F.arrays_zip("ids", "scores")).alias("p")
    every_one = first.select("row", "id", pairs).unionByName(rest.select("row", "id", pairs))
    order = Window.partitionBy("row").orderBy(F.desc("p.scores"), "p.ids")
    ranked = every_one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), "rank", F.col("p.ids").alias("vec_id"), F.col("p.scores").alias("score"))
