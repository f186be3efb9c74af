"""Problem 1: the most similar vectors of every vector, by collision-counting hashing.

Every vector is stored in the cells of its nearest pivots (a sample of the vectors), so that close vectors share
a cell. There are as many pivots as the root of the table, times a constant, so that the work for a vector grows
no faster than that root, whether it meets pivots or the vectors of its cells. In a cell, each of PROJECTIONS
random projections is one sorted array with a window centred on each vector, as wide as the least cosine asks;
two vectors that fall into each other's windows in at least COLLISIONS arrays are verified by their exact cosine.
Collisions are counted by comparing ranks for a block of pairs at a time, which takes less than growing the
windows level by level. Cells are split into tiles by their loads, as the sample has them, so that no task holds
more than about two tiles; no vector, partner or candidate is dropped. Vectors of different lengths are searched
apart.

Exact copies are found by a hash of the vector. They are compared once as one vector and joined again at the
end, the smallest row_idx first, so that a group of copies never makes more than k pairs per member.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS, COLLISIONS, SEED = 32, 16, 20_240_229
#: Half width of a window as a multiple of the radius that the least cosine gives.
WIDTH = 1.0
#: Least vectors per pivot; most vectors in a tile.
PER_PIVOT, TILE = 120, 50_000
#: Pivots are at most the root of SPREAD times the vectors, so that neither the search for a vector's pivots nor
#: that in its cells grows faster than the root of the table.
SPREAD = 20
#: Pairs that are counted at once: a block stays in the processor's cache.
BLOCK = 1 << 18
#: Pairs that wait until each vector's best are chosen again.
MOST_WAITING = 1_000_000
#: Vectors in the sample that gives the pivots and the cells' loads: LEAST_SAMPLE, or twice the pivots.
LEAST_SAMPLE = 20_000
#: A vector is stored with each pivot within MARGIN of its best one: at least 2, at most MOST_CELLS.
MARGIN, MOST_CELLS = 0.07, 5
HEADS_SALT = 16

_FOUND = "q1 bigint, q2 bigint, n1 bigint, n2 bigint, score double"


def _units(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows' positions and unit vectors; null, zero, non-finite and odd-sized vectors are left out."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, int)
    good = (lengths == size) & column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(good)
    if not len(rows):
        return rows, np.empty((0, size), np.float32)
    starts = column.offsets.to_numpy()[:-1][rows]
    x = column.values.to_numpy(zero_copy_only=False)[starts[:, None] + np.arange(size)].astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    fine = np.isfinite(norm) & (norm > 0)
    return rows[fine], (x[fine] / norm[fine, None]).astype(np.float32)


def _pivot_count(n: int) -> int:
    return max(1, min(n // PER_PIVOT, math.isqrt(int(SPREAD * n))))


def _cells(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of each storage place of the vectors."""
    at, cells = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(64, (1 << 20) // len(pivots))
    for lo in range(0, len(x), step):
        s = x[lo : lo + step] @ pivots.T
        best = s.max(axis=1)
        row, cell = np.nonzero(s >= best[:, None] - MARGIN)
        n = np.bincount(row, minlength=len(s))
        if (n > MOST_CELLS).any():
            order = np.lexsort((-s[row, cell], row))
            row, cell = row[order], cell[order]
            kept = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) < MOST_CELLS
            row, cell = row[kept], cell[kept]
        if s.shape[1] > 1 and len(alone := np.flatnonzero(n < 2)):
            others = s[alone]
            others[np.arange(len(alone)), others.argmax(axis=1)] = -np.inf
            row, cell = np.concatenate([row, alone]), np.concatenate([cell, others.argmax(axis=1)])
        at.append(row + lo)
        cells.append(cell)
    return np.concatenate(at), np.concatenate(cells)


def _stored(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, row numbers, vectors, row of each place, cell of each place), copies within the task once."""
    seen: set[tuple[int, int]] = set()
    for whole in batches:
        for start in range(0, whole.num_rows, 1024):
            batch = whole.slice(start, 1024)
            column = pa.concat_arrays([batch.column("vector")])
            rows, x = _units(column, pivots.shape[1])
            ids = np.stack([batch.column(c).to_numpy()[rows] for c in ("id1", "id2")], axis=1)
            new = []
            for n, key in enumerate(map(tuple, ids.tolist())):
                if key not in seen:
                    seen.add(key)
                    new.append(n)
            if new:
                x = x[new]
                yield (ids[new], batch.column("row_idx").to_numpy()[rows][new], x, *_cells(x, pivots))


def count_collisions(x: np.ndarray, radius: float, score_at_least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left, right, cosine) of the verified pairs of the unit vectors x, left before right, block by block of all pairs.

    The window of a vector reaches in each sorted array from its rank to before its end, so two meet if each one's
    rank is before the other's end. A block's cosines come from one product, which takes less than gathering the
    vectors of its candidates; those near the least cosine or above it are computed again in double precision.
    """
    n = len(x)
    a = np.random.default_rng(SEED).standard_normal((x.shape[1], PROJECTIONS)).astype(np.float32)
    h = x @ a
    small = np.uint16 if n < 1 << 16 else np.uint32
    rank, end = np.empty((PROJECTIONS, n), small), np.empty((PROJECTIONS, n), small)
    for p in range(PROJECTIONS):
        order = np.argsort(h[:, p], kind="stable")
        sorted_ = h[order, p]
        rank[p, order] = np.arange(n)
        end[p, order] = np.searchsorted(sorted_, sorted_ + WIDTH * radius, side="right")
    # the same memory for every block, as fresh pages cost more than what is written to them
    room = [np.empty(max(n, min(BLOCK, n * n)), kind) for kind in (np.uint8, bool, bool, np.float32)]
    lo = 0
    while lo < n:
        hi = min(n, lo + max(1, BLOCK // (n - lo)))
        count, one, two, product = (r[: (hi - lo) * (n - lo)].reshape(hi - lo, n - lo) for r in room)
        count[:] = 0
        for ranks, ends in zip(rank, end):
            np.less(ranks[None, lo:], ends[lo:hi, None], out=one)
            np.less(ranks[lo:hi, None], ends[None, lo:], out=two)
            one &= two
            count += one.view(np.uint8)
        np.greater_equal(count, COLLISIONS, out=one)
        one &= np.greater_equal(np.matmul(x[lo:hi], x[lo:].T, out=product), score_at_least - 1e-3, out=two)
        i, j = np.divmod(np.flatnonzero(one.reshape(-1)), n - lo)
        later = j > i
        i, j = i[later] + lo, j[later] + lo
        for at in range(0, len(i), 1 << 14):
            l, r = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            c = np.einsum("ij,ij->i", x[l].astype(np.float64), x[r].astype(np.float64))
            good = c >= score_at_least - 1e-9
            yield l[good], r[good], c[good]
        lo = hi


def _best(left: np.ndarray, right: np.ndarray, score: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Positions, in the pairs taken both ways, of each left's k best: by score, then by the right's smaller row number."""
    order = np.lexsort((row[right], -np.round(score, 9), left))
    l = left[order]
    starts = np.flatnonzero(np.append(True, np.diff(l) != 0))
    rank = np.arange(len(l)) - np.repeat(starts, np.diff(np.append(starts, len(l))))
    return order[rank < k]


def _best_of(pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], row: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The pairs taken both ways, of each left its k best. No more than MOST_WAITING and a block wait beside the best."""
    waiting = [(np.empty(0, int), np.empty(0, int), np.empty(0))]

    def chosen() -> tuple[np.ndarray, ...]:
        left, right, score = (np.concatenate(v) for v in zip(*waiting))
        kept = _best(left, right, score, row, k) if len(left) else slice(0)
        return left[kept], right[kept], score[kept]

    held = 0
    for l, r, s in pairs:
        waiting += [(l, r, s), (r, l, s)]
        held += 2 * len(l)
        if held > MOST_WAITING:
            waiting, held = [chosen()], 0
    return chosen()


def similar_vectors(vectors: DataFrame, k: int = 5, score_at_least: float = 0.85, key: str = "row_idx", vector: str = "vector") -> DataFrame:
    """(left_row_idx, right_row_idx, score), the smaller first, each pair once: the cosine is at least
    score_at_least and one of the two is among the k most similar of the other (ties: smaller key first).

    Null, all-zero and non-finite vectors are in no pair, and vectors of different lengths make none; an empty
    table gives none. Copies of a vector have the score 1. Recall against brute force is measured in the
    tests and in the README (over 0.98); scores are exact.
    """
    spark = vectors.sparkSession
    v = F.col(vector).cast("array<float>")
    rows = vectors.select(F.col(key).cast("bigint").alias("row_idx"), v.alias("vector")).where("row_idx is not null and vector is not null")

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            column = pa.concat_arrays([batch.column(0)])
            lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, int)
            for size in np.unique(lengths):
                found[int(size)] += len(_units(column, int(size))[0])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["size", "n"])

    counted = rows.select("vector").mapInArrow(usable, "size int, n bigint").groupBy("size").agg(F.sum("n").alias("n")).where("n > 1").collect()  # a row per length of vectors
    parts = [_of_size(rows.where(F.size("vector") == r["size"]), r["size"], r["n"], k, score_at_least) for r in sorted(counted)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "left_row_idx bigint, right_row_idx bigint, score double")


def _sampled(rows: DataFrame, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(pivots, tiles of each pivot's cell), from a bounded sample by a hash of the key."""
    pivots = _pivot_count(n)
    wanted = max(LEAST_SAMPLE, 2 * pivots)
    total = rows.count() if n <= wanted else n  # unusable vectors are few, or the table is small
    sample = rows.where(F.pmod(F.xxhash64("row_idx", F.lit(SEED)), F.lit(max(total, 1))) < wanted).select("vector").limit(2 * wanted).toArrow()
    x = _units(pa.concat_arrays(sample.column(0).chunks) if sample.num_rows else pa.array([], pa.list_(pa.float32())), size)[1]
    drawn = len(x)
    x = np.unique(x, axis=0)[np.random.default_rng(SEED).permutation(len(np.unique(x, axis=0)))]
    held = np.zeros(min(pivots, len(x)), dtype=np.int64)
    for lo in range(0, len(x), 1024):
        held += np.bincount(_cells(x[lo : lo + 1024], x[:pivots])[1], minlength=len(held))
    return x[:pivots], -(-(held * n) // (max(1, drawn) * TILE))


def _of_size(rows: DataFrame, size: int, n: int, k: int, score_at_least: float) -> DataFrame:
    """The pairs among the vectors of one length, n of which are usable."""
    spark = rows.sparkSession
    pivots, tiles = _sampled(rows, size, n)
    if not len(pivots):  # a sample without any usable vector: the first one there is
        first = rows.where(_usable(size)).select("vector").limit(1).toArrow()
        pivots, tiles = _units(pa.concat_arrays(first.column(0).chunks), size)[1], np.array([-(-n // TILE)])
    shared = spark.sparkContext.broadcast(pivots)
    shared_tiles = spark.sparkContext.broadcast(np.maximum(tiles, 1))
    rows = rows.select("row_idx", F.xxhash64("vector").alias("id1"), F.xxhash64(F.lit(SEED), "vector").alias("id2"), "vector")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = shared_tiles.value
        for ids, row, x, at, cell in _stored(batches, shared.value):
            t = split[cell]
            own = (ids[at, 0] & 0x7FFFFFFF) % t
            # a tile meets every tile of its cell once: the task (a, b), a <= b, has both
            place = np.repeat(np.arange(len(at)), t)
            other = np.arange(len(place)) - np.repeat(np.cumsum(t) - t, t)
            a, b = np.minimum(own[place], other), np.maximum(own[place], other)
            i = at[place]
            flat = pa.py_buffer(np.ascontiguousarray(x[i]).tobytes())
            bytes_ = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * size), len(i), [None, flat]).cast(pa.binary())
            columns = [pa.array(c) for c in (cell[place].astype(np.int32), a.astype(np.int32), b.astype(np.int32), own[place].astype(np.int32), ids[i, 0], ids[i, 1], row[i])]
            yield pa.RecordBatch.from_arrays([*columns, bytes_], ["cell", "a", "b", "own", "id1", "id2", "row_idx", "x"])

    radius = float(np.sqrt(max(0.0, 2 - 2 * score_at_least)))

    def search(table: pa.Table) -> pa.Table:
        ids = np.stack([table.column(c).to_numpy() for c in ("id1", "id2")], axis=1)
        row = table.column("row_idx").to_numpy()
        order = np.lexsort((row, ids[:, 1], ids[:, 0]))
        first = np.append(True, (np.diff(ids[order], axis=0) != 0).any(axis=1))
        keep = order[first]
        x = np.frombuffer(b"".join(table.column("x").take(pa.array(keep)).to_pylist()), dtype=np.float32).reshape(-1, size)
        ids, row, own = ids[keep], row[keep], table.column("own").to_numpy()[keep]
        pairs = count_collisions(x, radius, score_at_least)
        if table.column("a")[0].as_py() != table.column("b")[0].as_py():
            pairs = ((l[across], r[across], s[across]) for l, r, s in pairs for across in [own[l] != own[r]])
        left, right, score = _best_of(pairs, row, k)
        return pa.table({"q1": ids[left, 0], "q2": ids[left, 1], "n1": ids[right, 0], "n2": ids[right, 1], "score": pa.array(score, pa.float64())})

    stored = rows.mapInArrow(store, "cell int, a int, b int, own int, id1 bigint, id2 bigint, row_idx bigint, x binary")
    found = stored.groupBy("cell", "a", "b").applyInArrow(search, _FOUND).groupBy("q1", "q2", "n1", "n2").agg(F.max("score").alias("score"))
    return _with_copies(rows.select("row_idx", "id1", "id2", _usable(size).alias("ok")).where("ok").drop("ok"), found, k)


def _usable(size: int):
    squares = F.aggregate("vector", F.lit(0.0), lambda a, y: a + y.cast("double") * y)
    return F.coalesce((F.size("vector") == size) & (squares > 0) & (squares < float("inf")), F.lit(False))


def _with_copies(rows: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """From pairs of distinct vectors to pairs of rows."""
    by_copy = Window.partitionBy("id1", "id2").orderBy("row_idx")
    # the k + 1 smallest of each group of copies are all that can be among anyone's k most similar
    heads = rows.withColumn("rank", F.row_number().over(by_copy)).where(F.col("rank") <= k + 1)
    groups = heads.groupBy("id1", "id2").agg(F.sort_array(F.collect_list("row_idx")).alias("heads"))
    linked = (
        found.join(groups.select(F.col("id1").alias("n1"), F.col("id2").alias("n2"), F.col("heads").alias("near")), ["n1", "n2"])
        .groupBy("q1", "q2").agg(F.collect_list(F.struct("score", "near")).alias("near"))
    )
    several = groups.join(linked, (F.col("id1") == F.col("q1")) & (F.col("id2") == F.col("q2")), "left").where((F.size("heads") > 1) | F.col("near").isNotNull())
    others = F.flatten(F.transform(F.coalesce("near", F.array().cast("array<struct<score:double,near:array<bigint>>>")), lambda g: F.transform(g["near"], lambda r: F.struct((-F.round(g["score"], 9)).alias("a"), r.alias("row"), g["score"].alias("score")))))
    own = F.transform("heads", lambda r: F.struct(F.lit(-1.0).alias("a"), r.alias("row"), F.lit(1.0).alias("score")))
    ranked = several.select("heads", F.array_sort(F.concat(own, others)).alias("list"))
    pairs = ranked.select(F.explode("heads").alias("row_idx"), "list").select("row_idx", F.explode(F.slice(F.filter("list", lambda x: x["row"] != F.col("row_idx")), 1, k)).alias("n")).select("row_idx", F.col("n.row").alias("other"), "n.score")
    # the rest of a large group of copies: its k most similar are the k smallest
    large = groups.where(F.size("heads") > k).select("id1", "id2", F.slice("heads", 1, k).alias("near"), F.col("heads")[k].alias("last"), F.explode(F.sequence(F.lit(0), F.lit(HEADS_SALT - 1))).alias("salt"))
    rest = rows.withColumn("salt", F.pmod("row_idx", F.lit(HEADS_SALT)).cast("int")).join(large, ["id1", "id2", "salt"]).where("row_idx > last")
    pairs = pairs.unionByName(rest.select("row_idx", F.explode("near").alias("other"), F.lit(1.0).alias("score")))
    return pairs.groupBy(F.least("row_idx", "other").alias("left_row_idx"), F.greatest("row_idx", "other").alias("right_row_idx")).agg(F.max("score").alias("score"))
