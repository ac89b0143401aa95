"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``PREFIX`` nearest pivots in order, and posted
with them in the inverted file of its first pivot. A query looks into the files
of its ``s`` nearest pivots; there, rows are ranked by the footrule distance of
the two prefixes (the sum of the differences of the pivots' places, a pivot
beyond the prefix being at place PREFIX), those within a limit are reranked by
the Euclidean distance, and the ``K`` best of each file are merged for each
query. Every row is posted, each once.

``s`` and the limit are calibrated at every size: ``SAMPLE`` queries are
compared with all rows exactly, and both are set so that ``TARGET`` of their
true neighbours' files are visited, and as many pass the limit. What the index
finds is taken over only for a query with ``K`` neighbours that lie as densely
as those of sampled queries which it served well; all other queries are
compared with every row, exactly and in blocks.

Files hold tiles of ``TILE`` rows and ``TILE`` queries, so that one of a crowded
pivot is the work of many tasks. There are twice as many pivots as the square
root of the rows, so the work of placing a row and the length of a file both
grow with that root; pivots are broadcast in parts of ``PIVOT_BYTES`` at most,
each part in a pass of its own, with the same result for any number of parts.

Result: (vec_id, rank, neighbor_id, distance), up to K rows for each query,
ranked by distance and then neighbor_id. The registered query asks for every
row whose vec_id is divisible by ``EVERY``, against all rows.

Defined results: null and empty vectors, those with a null, NaN or infinite
part, and those whose length isn't the most common one (the greatest, at a
tie) have no neighbours and are nobody's; rows with a null vec_id are left
out; rows with the same vec_id are one vector with several places and never
each other's neighbours; an empty table, or no query, gives an empty result;
only vec_id and embedding are read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartwood.llm.common import cut, map_batches
from heartwood.llm.ego import matrix, usable

K = 10
EVERY = 100
PREFIX = 32
SAMPLE = 200
TARGET = 0.975
#: Most bytes of pivots that are broadcast at once.
PIVOT_BYTES = 64 << 20
#: Rows and queries of a tile; a tile of one with a tile of the other is compared at once.
TILE = 4_096
#: Least recall of the index, on any window of sampled queries of similar density, for its rows to be taken over.
SERVED = 0.9
_WINDOW = 20
#: Bytes of queries that are broadcast at once for the exact pass, and rows compared at once.
EXACT_BYTES = 32 << 20
_ROWS = 256


@functools.cache
def _offsets(size: int) -> np.ndarray:
    return size - np.arange(size, dtype=np.int16)


def prefixes(x: np.ndarray, pivots: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, size) numbers of the nearest pivots of each row, nearest first, ties by number; and what orders them."""
    out, score = np.empty((len(x), size), dtype=np.int32), np.empty((len(x), size))
    half = (pivots * pivots).sum(1) / 2
    for k in range(0, len(x), 1024):
        d = half[None] - x[k : k + 1024] @ pivots.T
        near = np.sort(np.argpartition(d, size - 1, axis=1)[:, :size], axis=1) if size < len(pivots) else np.tile(np.arange(size), (len(d), 1))
        by = np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable")
        out[k : k + 1024] = np.take_along_axis(near, by, 1)
        score[k : k + 1024] = np.take_along_axis(d, out[k : k + 1024], 1)
    return out, score


def merged(old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivots of two disjoint sets of them."""
    p, d = (np.concatenate(x, axis=1) for x in zip(old, new, strict=True))
    by = np.lexsort((p, d))[:, :size]
    return np.take_along_axis(p, by, 1), np.take_along_axis(d, by, 1)


def shared_places(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(n, m): sums over shared pivots of the lesser of both's nearness; the footrule distance is size * (size + 1) less twice this."""
    size = queries.shape[1]
    known, at = np.unique(rows, return_inverse=True)
    near = np.zeros((len(queries), len(known) + 1), dtype=np.int16)
    place = np.minimum(np.searchsorted(known, queries), len(known) - 1)
    place = np.where(known[place] == queries, place, len(known))
    np.put_along_axis(near, place, _offsets(size)[None], axis=1)
    near[:, -1] = 0
    out = np.zeros((len(queries), len(rows)), dtype=np.int32)
    at = at.reshape(rows.shape)
    for k in range(size):
        out += np.minimum(near[:, at[:, k]], size - k)
    return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = x - y
    return np.sqrt((gap * gap).sum(-1))


def best(q: np.ndarray, o: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest different o of each q, in order of q, distance and o."""
    order = np.lexsort((d, o, q))
    new = np.ones(len(q), dtype=bool)
    new[1:] = (q[order][1:] != q[order][:-1]) | (o[order][1:] != o[order][:-1])
    order = order[new]
    order = order[np.lexsort((o[order], d[order], q[order]))]
    q = q[order]
    first = np.ones(len(q), dtype=bool)
    first[1:] = q[1:] != q[:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[np.arange(len(q)) - start < k]


class Nearest:
    """The k nearest different ids of each of x's rows among all rows that are added: exact, ties by the lesser id."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, k: int):
        self.x, self.ids, self.k = x, ids, k
        self.half = (x * x).sum(1)
        self.d, self.o = np.full((len(x), k), np.inf), np.zeros((len(x), k), dtype=np.int64)

    def add(self, y: np.ndarray, theirs: np.ndarray, allowed=None) -> None:
        """``allowed(a, b)``: which of the rows may be neighbours of x[a:b]; all of them if that isn't given."""
        by = np.argsort(theirs, kind="stable")
        y, theirs = y[by], theirs[by]
        starts = np.flatnonzero(np.concatenate([[True], theirs[1:] != theirs[:-1]]))
        half = (y * y).sum(1)
        for a in range(0, len(self.x), _ROWS):
            b = min(a + _ROWS, len(self.x))
            d2 = self.half[a:b, None] + half[None] - 2 * self.x[a:b] @ y.T
            if allowed is not None:
                d2[~allowed(a, b)[:, by]] = np.inf
            # an id's own places are left out; rounding never leaves out a pair
            place = np.searchsorted(theirs, self.ids[a:b]), np.searchsorted(theirs, self.ids[a:b], side="right")
            for r in np.flatnonzero(place[1] > place[0]):
                d2[r, place[0][r] : place[1][r]] = np.inf
            bound = self.d[a:b, -1] ** 2
            if not np.isfinite(bound).all() and len(starts) > self.k:
                least = np.minimum.reduceat(d2, starts, axis=1) if len(starts) < len(y) else d2
                bound = np.minimum(bound, np.partition(least, self.k - 1, axis=1)[:, self.k - 1])
            slack = 1e-9 * (self.half[a:b] + half.max())
            i, j = np.nonzero((d2 <= (bound + slack)[:, None]) & (d2 < np.inf))
            if not len(i):
                continue
            rows = np.unique(i)
            old_i, old_k = np.nonzero(np.isfinite(self.d[a:b][rows]))
            old_i = rows[old_i]
            q = np.concatenate([old_i, i])
            old = np.searchsorted(rows, old_i)
            o = np.concatenate([self.o[a:b][rows][old, old_k], theirs[j]])
            d = np.concatenate([self.d[a:b][rows][old, old_k], distances(self.x[a:b][i], y[j])])
            keep = best(q, o, d, self.k)
            q, o, d = q[keep], o[keep], d[keep]
            at = np.arange(len(q)) - np.searchsorted(q, q)
            self.d[a + q, at], self.o[a + q, at] = d, o


def exact(rows: DataFrame, x: np.ndarray, ids: np.ndarray, dim: int, k: int) -> DataFrame:
    """(vec_id, o, d): the k nearest of the vectors x in each partition of rows, and so among them those in all."""
    shared = rows.sparkSession.sparkContext.broadcast((x, ids))

    def run(batches):
        near = Nearest(*shared.value, k)
        for batch in batches:
            near.add(matrix(batch.column("embedding"), dim), batch.column("vec_id").to_numpy())
        for a in range(0, len(near.x), 10 * _ROWS):
            d = near.d[a : a + 10 * _ROWS]
            i, j = np.nonzero(np.isfinite(d))
            yield pa.RecordBatch.from_arrays([pa.array(near.ids[a + i]), pa.array(near.o[a + i, j]), pa.array(d[i, j])], ["vec_id", "o", "d"])

    return map_batches(rows.select("vec_id", "embedding"), run, "vec_id long, o long, d double")


def trusted(kth: np.ndarray, recall: np.ndarray) -> float:
    """The distance up to which a vector's k-th neighbour by the index is believed.

    In order of the true k-th distance, up to the first sampled row that the index mostly misses or the first window that it serves badly.
    """
    by = np.argsort(kth, kind="stable")
    kth, recall = kth[by], recall[by]
    bad = recall < 0.5
    if len(recall) >= _WINDOW:
        means = np.convolve(recall, np.ones(_WINDOW) / _WINDOW, mode="valid")
        low = np.flatnonzero(means < SERVED)
        if len(low):
            bad[low[0] :] = True
    first = int(np.argmax(bad)) if bad.any() else len(bad)
    return float(kth[first - 1]) if first else -1.0


def calibrate(placed: DataFrame, x: np.ndarray, ids: np.ndarray, order: np.ndarray, size: int, dim: int, k: int, target: float) -> tuple[int, int, float]:
    """(files to visit, least sum of shared places, distance up to which queries are trusted) by the true neighbours of sampled queries among all rows.

    order: all pivots for each of the queries, nearest first.
    """
    shared = placed.sparkSession.sparkContext.broadcast((x, ids, np.argsort(order, axis=1), np.ascontiguousarray(order[:, :size])))

    def run(batches):
        x, ids, place, prefix = shared.value
        held: list[np.ndarray] = [np.zeros((0, 5))]
        half = (x * x).sum(1)
        for batch in batches:
            y, theirs = matrix(batch.column("embedding"), dim), batch.column("vec_id").to_numpy()
            yp = batch.column("prefix").flatten().to_numpy().reshape(-1, size)
            d2 = half[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T
            d2[ids[:, None] == theirs[None]] = np.inf
            by = np.argsort(theirs, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], theirs[by][1:] != theirs[by][:-1]]))
            least = np.minimum.reduceat(d2[:, by], starts, axis=1) if len(starts) < len(y) else d2
            limit = np.partition(least, min(k, len(starts)) - 1, axis=1)[:, min(k, len(starts)) - 1]
            i, j = np.nonzero((d2 <= limit[:, None]) & np.isfinite(d2))
            places = np.array([shared_places(prefix[a : a + 1], yp[b : b + 1])[0, 0] for a, b in zip(i.tolist(), j.tolist(), strict=True)] if len(i) < 500 else shared_places(prefix, yp)[i, j])
            held.append(np.stack([i, theirs[j], np.maximum(d2[i, j], 0), place[i, yp[j, 0]] + 1, places], axis=1))
            if len(held) > 8:
                rows = np.concatenate(held)
                held = [rows[best(rows[:, 0], rows[:, 1], rows[:, 2], k)]]
        rows = np.concatenate(held)
        rows = rows[best(rows[:, 0], rows[:, 1], rows[:, 2], k)]
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].astype(np.int32)), pa.array(rows[:, 1].astype(np.int64)), pa.array(rows[:, 2]), pa.array(rows[:, 3].astype(np.int32)), pa.array(rows[:, 4].astype(np.int32))], ["q", "o", "d", "s", "places"])

    near = map_batches(placed.select("vec_id", "embedding", "prefix"), run, "q int, o long, d double, s int, places int")
    near = near.groupBy("q", "o").agg(F.min(F.struct("d", "s", "places")).alias("n"))
    nearest = F.slice(F.array_sort(F.collect_list("n")), 1, k)
    true = near.groupBy("q").agg(nearest.alias("n")).collect()
    if not true:
        return 1, 0, -1.0
    pairs = [np.array([[p["d"], p["s"], p["places"]] for p in r["n"]]) for r in true]
    flat = np.concatenate(pairs)
    s, limit = int(np.quantile(flat[:, 1], target, method="higher")), int(np.quantile(flat[:, 2], 1 - target, method="lower"))
    recall = np.array([((p[:, 1] <= s) & (p[:, 2] >= limit)).mean() for p in pairs])
    return s, limit, trusted(np.sqrt([p[:, 0].max() for p in pairs]), recall)


def neighbors(queries: DataFrame, vectors: DataFrame, k: int = K, prefix: int = PREFIX, sample: int = SAMPLE, target: float = TARGET, tile: int = TILE, pivot_bytes: int = PIVOT_BYTES) -> DataFrame:
    """The k nearest different ids among ``vectors`` of every row of ``queries`` (vec_id, embedding), which may be rows of theirs or others."""
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "vec_id long, rank int, neighbor_id long, distance double")
    fine = usable(vectors).distinct()
    top = fine.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if top is None:
        return nothing
    dim, n = top["size"], top["count"]
    fine = cut(fine.where(F.size("embedding") == dim))
    asked = cut(usable(queries).distinct().where(F.size("embedding") == dim))
    total = asked.count()
    if not total:
        return nothing
    m = int(min(n, max(2 * prefix, np.ceil(2 * np.sqrt(n)))))
    size = min(prefix, m)
    # pivots and sample are drawn by the least hashes, kept up on the executors: no more than m rows reach the driver
    draw = lambda rows, salt, number: rows.orderBy(F.xxhash64("vec_id", F.lit(salt)), "vec_id", "embedding").limit(number).toArrow()
    pivots = matrix(draw(fine, 5, m).column("embedding").combine_chunks(), dim)
    own = draw(asked, 6, sample)
    x, ids = matrix(own.column("embedding").combine_chunks(), dim), own.column("vec_id").to_numpy()
    each = max(1, pivot_bytes // (8 * dim))
    parts = [(a, spark.sparkContext.broadcast(pivots[a : a + each])) for a in range(0, m, each)]

    def place(rows: DataFrame, size: int) -> DataFrame:
        """``rows`` with the numbers of their ``size`` nearest pivots."""
        vector = rows.schema["embedding"].dataType.simpleString()
        out = rows.select("vec_id", "embedding", F.array().cast("array<int>").alias("prefix"), F.array().cast("array<double>").alias("score"))
        for first, part in parts:

            def run(batches, first=first, part=part):
                for batch in batches:
                    p, d = prefixes(matrix(batch.column("embedding"), dim), part.value, min(size, len(part.value)))
                    p = p + np.int32(first)
                    if first:
                        was = [batch.column(c).flatten().to_numpy().reshape(len(p), -1) for c in ("prefix", "score")]
                        p, d = merged((was[0], was[1]), (p, d), size)
                    ends = pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1])
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.ListArray.from_arrays(ends, pa.array(p.ravel().astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(d.ravel()))], ["vec_id", "embedding", "prefix", "score"])

            out = map_batches(out, run, f"vec_id long, embedding {vector}, prefix array<int>, score array<double>")
        return cut(out.drop("score"))

    placed = place(fine, size)
    s, limit, trust = calibrate(placed, x, ids, prefixes(x, pivots, m)[0], size, dim, k, target)
    posted = placed.withColumn("file", F.element_at("prefix", 1))
    probes = place(asked, max(s, size)).select("vec_id", "embedding", F.slice("prefix", 1, size).alias("prefix"), F.explode(F.slice("prefix", 1, s)).alias("file"))
    tiles = lambda rows, name: rows.groupBy("file").agg(F.ceil(F.count("*") / tile).cast("int").alias(name))
    sizes = cut(tiles(posted, "t").join(tiles(probes, "u"), "file"))
    spread = lambda rows, mine, other: rows.join(sizes, "file").select("vec_id", "embedding", "prefix", "file", F.pmod(F.xxhash64("vec_id"), F.col(mine)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))

    def run(rows: pa.Table, asking: pa.Table) -> pa.Table:
        take = lambda side: (matrix(side.column("embedding").combine_chunks(), dim), side.column("vec_id").to_numpy(), side.column("prefix").combine_chunks().flatten().to_numpy().reshape(-1, size))
        if not rows.num_rows or not asking.num_rows:
            return pa.table({"vec_id": pa.array([], pa.int64()), "o": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        (y, theirs, yp), (x, ids, xp) = take(rows), take(asking)
        near = Nearest(x, ids, k)
        near.add(y, theirs, lambda a, b: shared_places(xp[a:b], yp) >= limit)
        i, j = np.nonzero(np.isfinite(near.d))
        return pa.table({"vec_id": near.ids[i], "o": near.o[i, j], "d": near.d[i, j]})

    jobs = spread(posted, "t", "u").groupBy("file", "t", "u").cogroup(spread(probes, "u", "t").groupBy("file", "t", "u"))
    found = jobs.applyInArrow(run, "vec_id long, o long, d double").groupBy("vec_id", "o").agg(F.min("d").alias("d"))
    nearest = F.slice(F.array_sort(F.collect_list(F.struct("d", "o"))), 1, k)
    kept = cut(found.groupBy("vec_id").agg(nearest.alias("near")))
    # queries that the index leaves with fewer than k neighbours, or that lie less densely than it was found to serve, are compared with all rows
    served = kept.where((F.size("near") == k) & (F.element_at("near", -1)["d"] <= trust))
    doubtful = cut(asked.join(served.select("vec_id"), "vec_id", "left_anti"))
    rest = doubtful.count()
    blocks = max(1, -(-rest * (8 * dim + 16 * k) // EXACT_BYTES))
    block = F.pmod(F.xxhash64("vec_id", "embedding", F.lit(7)), F.lit(blocks))
    near = []
    for own in (doubtful.where(block == p).select("vec_id", "embedding").toArrow() for p in range(blocks if rest else 0)):
        if own.num_rows:
            near.append(exact(fine, matrix(own.column("embedding").combine_chunks(), dim), own.column("vec_id").to_numpy(), dim, k))
    if near:
        pairs = functools.reduce(DataFrame.unionByName, near).groupBy("vec_id", "o").agg(F.min("d").alias("d"))
        served = served.unionByName(pairs.groupBy("vec_id").agg(nearest.alias("near")))
    return served.select("vec_id", F.posexplode("near").alias("at", "n")).select("vec_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.o").alias("neighbor_id"), F.col("n.d").alias("distance"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbors(vectors.where(F.col("vec_id") % EVERY == 0), vectors)
