"""Embedding near-dedup by an epsilon grid order join.

Vectors are turned to their principal axes, and the grid of cells of side
``EPS`` on the leading axes orders them lexicographically. The sequence is cut
into intervals; two intervals can hold a pair only if their boxes on the
leading axes are within EPS. Pairs of intervals are found by an equi-join on
the cells of the first two axes that they occupy, and joined recursively: a
pair of sequence intervals whose boxes are too far apart is skipped, any other
is halved until it is small; of these pairs of rows those too far apart on the
leading axes go first, and the rest is compared exactly.

Equal vectors are one node, so a group of copies costs one comparison.

Result: (vec_id, group_id, group_size, links, kept): groups are the connected
components of pairs at a Euclidean distance of EPS or less; links counts the
different vectors within EPS of this one (itself and its copies left out); the
least vec_id names its group and is kept.

Defined results: null and empty vectors, and those with a null, NaN or
infinite part, are groups of one, and so are vectors whose length isn't the
most common one (the greatest, at a tie); they have 0 links. Rows with the same
vec_id are one vector with several places, whose links add up; rows with a null
vec_id are left out; equal vectors are at distance 0. Vectors may be of any
size and lie anywhere: an outlier occupies one cell. Only vec_id and embedding
are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartwood.llm.common import connected, cut, forest, map_batches

EPS = 0.2
#: Leading axes that are projected and bound the boxes, and those of them that order the sequence.
AXES = 16
ORDERED = 6
#: Vectors of an interval; a pair of intervals is one task's work, below a second.
INTERVAL = 8_192
_SMALL = 128
#: Beyond this size of a part, squares could overflow and rows are compared by their differences.
_HUGE = 1e100
#: Cells farther out than this are one cell.
_FAR = 1e15


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of rows with an id and finite parts; 32-bit parts stay so."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size("embedding") > 0) & fine)


def axes(vectors: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes, from sums over all vectors but far outliers: the driver gets size**2 numbers, however many vectors there are.

    Any axes give the right pairs; those of outliers would tell the others badly apart.
    """
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    usual = vectors.agg(F.percentile_approx(norm, 0.5)).first()[0]

    def run(batches):
        total = np.zeros(1 + size + size * size)
        for batch in batches:
            x = matrix(batch.column("embedding"), size)
            with np.errstate(over="ignore"):
                x = x[np.sqrt((x * x).sum(1)) <= 10 * usual]
            total += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

    if usual is None or not usual < _HUGE:
        return np.zeros(size), np.eye(size)
    sums = {r["k"]: r["v"] for r in map_batches(vectors.select("embedding"), run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    if not sums or not sums[0]:
        return np.zeros(size), np.eye(size)
    n = sums[0]
    mean = np.array([sums[1 + k] for k in range(size)]) / n
    cov = np.array([sums[1 + size + k] for k in range(size * size)]).reshape(size, size) / n - np.outer(mean, mean)
    return mean, np.linalg.eigh(cov)[1][:, ::-1]


def gaps(lo: np.ndarray, hi: np.ndarray, other_lo: np.ndarray, other_hi: np.ndarray) -> np.ndarray:
    """Least distances on each axis between boxes, less what rounding may have added."""
    size = np.maximum(np.maximum(abs(lo), abs(hi)), np.maximum(abs(other_lo), abs(other_hi)))
    return np.maximum(0, np.maximum(lo - other_hi, other_lo - hi) - 1e-12 * size)


def _near(p: np.ndarray, q: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose squared distance is eps**2 at most, or could be but for rounding: one product of matrices."""
    kind = np.float32 if max(abs(p).max(), abs(q).max()) < 1e3 else np.float64
    slack = 4 * (p.shape[1] + 2) * float(np.finfo(kind).eps)
    pp, qq = (p * p).sum(1) * (1 - slack), (q * q).sum(1) * (1 - slack)
    one = np.ones(1, dtype=kind)
    left = np.concatenate([(-2 * p).astype(kind), pp[:, None].astype(kind), np.broadcast_to(one, (len(p), 1))], axis=1)
    right = np.concatenate([q.astype(kind), np.broadcast_to(one, (len(q), 1)), qq[:, None].astype(kind)], axis=1)
    return np.nonzero(left @ right.T <= eps * eps * (1 + 1e-6))


def joined(x: np.ndarray, y: np.ndarray, gx: np.ndarray, gy: np.ndarray, eps: float, skipped: list[int] | None = None):
    """Index pairs within eps, by recursion over two sequences in grid order; ``x is y`` gives each pair once.

    gx, gy: the coordinates on the leading axes.
    """
    same = x is y
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d:
            continue
        box, other = gx[a:b], gy[c:d]
        gap = gaps(box.min(0), box.max(0), other.min(0), other.max(0))
        if (gap * gap).sum() > eps * eps * (1 + 1e-9):
            if skipped is not None:
                skipped.append((b - a) * (d - c))
            continue
        if max(b - a, d - c) <= _SMALL:
            if max(abs(x[a:b]).max(), abs(y[c:d]).max()) < _HUGE:
                i, j = _near(box, other, eps)
            else:
                i, j = (k.ravel() for k in np.indices((b - a, d - c)))
            if same and a == c:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 16):
                u, v = i[k : k + (1 << 16)] + a, j[k : k + (1 << 16)] + c
                with np.errstate(over="ignore"):
                    ok = np.sqrt(((x[u] - y[v]) ** 2).sum(1)) <= eps
                if ok.any():
                    yield u[ok], v[ok]
        elif same and a == c and b == d:
            m = (a + b) // 2
            todo += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]


def edges(nodes: DataFrame, size: int, eps: float, interval: int = INTERVAL) -> DataFrame:
    """(a, b, n): links (n is 0) that connect the same groups as all pairs within eps; and, where a is b, a part n of a's number of pairs.

    nodes: (vec_id, embedding), each vector once.
    """
    spark = nodes.sparkSession
    m = min(AXES, size)
    mean, turn = axes(nodes, size)
    shared = spark.sparkContext.broadcast((mean, np.ascontiguousarray(turn[:, :m])))
    floats = nodes.schema["embedding"].dataType.simpleString()

    def project(batches):
        mean, turn = shared.value
        for batch in batches:
            g = (matrix(batch.column("embedding"), size) - mean) @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(g) + 1, dtype=np.int32) * m), pa.array(g.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), lists], ["vec_id", "embedding", "g"])

    placed = map_batches(nodes, project, f"vec_id long, embedding {floats}, g array<double>")
    cell = lambda v: F.floor(F.greatest(F.least(v / eps, F.lit(_FAR)), F.lit(-_FAR))).cast("long")
    places = [cell(F.col("g")[k]) for k in range(min(ORDERED, m))]
    ordered = placed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *places).sortWithinPartitions(*places, "vec_id")

    def number(batches):
        first = TaskContext.get().partitionId() << 32
        seen = 0
        for batch in batches:
            at = first + (np.arange(seen, seen + len(batch)) // interval)
            seen += len(batch)
            yield pa.RecordBatch.from_arrays([pa.array(at), *(batch.column(c) for c in ("vec_id", "embedding", "g"))], ["interval", "vec_id", "embedding", "g"])

    sequence = cut(map_batches(ordered, number, f"interval long, vec_id long, embedding {floats}, g array<double>"))
    box = sequence.groupBy("interval").agg(F.array(*[F.min(F.col("g")[k]) for k in range(m)]).alias("lo"), F.array(*[F.max(F.col("g")[k]) for k in range(m)]).alias("hi"))
    # partners occupy the same cells of the first two axes, or cells next to them
    c0, c1 = cell(F.col("g")[0]), cell(F.col("g")[1]) if m > 1 else F.lit(0).cast("long")
    occupied = sequence.select("interval", c0.alias("c0"), c1.alias("c1")).distinct()
    around = lambda c: F.explode(F.array(*[F.col(c) + k for k in (-1, 0, 1)])).alias(c)
    beside = occupied.select(F.col("interval").alias("i"), around("c0"), "c1").select("i", "c0", around("c1")).distinct()
    pairs = beside.join(occupied, ["c0", "c1"]).where("i <= interval").select("i", F.col("interval").alias("j")).distinct()
    pairs = pairs.join(box.select(F.col("interval").alias("i"), F.col("lo").alias("x_lo"), F.col("hi").alias("x_hi")), "i").join(box.withColumnRenamed("interval", "j"), "j")
    between = F.zip_with(F.zip_with("x_lo", "hi", lambda a, b: a - b - 1e-12 * F.greatest(F.abs(a), F.abs(b))), F.zip_with("lo", "x_hi", lambda a, b: a - b - 1e-12 * F.greatest(F.abs(a), F.abs(b))), lambda a, b: F.greatest(F.lit(0.0), a, b))
    pairs = pairs.where(F.aggregate(between, F.lit(0.0), lambda a, v: a + v * v) <= eps * eps * (1 + 1e-9)).select("i", "j").withColumn("job", F.xxhash64("i", "j"))
    sides = pairs.select("job", F.col("i").alias("interval"), F.lit(0).alias("side")).unionByName(pairs.where("i <> j").select("job", F.col("j").alias("interval"), F.lit(1).alias("side")))

    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        ids = group.column("vec_id").to_numpy()
        x, g = (matrix(group.column(c).combine_chunks(), w) for c, w in (("embedding", size), ("g", m)))
        order = np.lexsort((ids, *np.floor(np.clip(g[:, :ORDERED] / eps, -_FAR, _FAR)).T[::-1], side))
        ids, x, g = ids[order], x[order], g[order]
        k = int((side == 0).sum())
        links = np.zeros(len(ids), dtype=np.int64)

        def counted(found):
            for i, j in found:
                np.add(links, np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids)), out=links)
                yield i, j

        found = ((i, j + k) for i, j in joined(x[:k], x[k:], g[:k], g[k:], eps)) if k < len(ids) else joined(x, x, g, g, eps)
        e = forest(counted(found), len(ids))
        some = np.flatnonzero(links)
        return pa.table({"a": np.concatenate([ids[e[:, 0]], ids[some]]), "b": np.concatenate([ids[e[:, 1]], ids[some]]), "n": np.concatenate([np.zeros(len(e), dtype=np.int64), links[some]])})

    work = sequence.join(sides, "interval").select("job", "side", "vec_id", "embedding", "g")
    return work.groupBy("job").applyInArrow(run, "a long, b long, n long")


def groups(vectors: DataFrame, eps: float = EPS, interval: int = INTERVAL) -> DataFrame:
    """(vec_id, group_id, links) of every id."""
    fine = usable(vectors)
    top = fine.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id IS NOT NULL").distinct()
    if top is None:
        return ids.select("vec_id", F.col("vec_id").alias("group_id"), F.lit(0).cast("long").alias("links"))
    fine = fine.where(F.size("embedding") == top["size"])
    nodes = cut(fine.groupBy("embedding").agg(F.min("vec_id").alias("vec_id")))
    found = cut(edges(nodes, top["size"], eps, interval))
    member = cut(fine.join(nodes.select("embedding", F.col("vec_id").alias("node")), "embedding").select("vec_id", "node").distinct())
    least = member.groupBy("vec_id").agg(F.min("node").alias("node"), F.count("*").alias("places"))
    several = member.join(least.where("places > 1").select("vec_id", F.col("node").alias("first")), "vec_id").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    roots = connected(found.select("a", "b").unionByName(several))
    counts = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    links = member.join(counts, "node").groupBy("vec_id").agg(F.sum("links").alias("links"))
    named = least.join(roots, "node", "left").select("vec_id", F.coalesce("root", "node").alias("group_id"))
    return ids.join(named, "vec_id", "left").join(links, "vec_id", "left").select("vec_id", F.coalesce("group_id", "vec_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sizes = g.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return g.join(sizes, "group_id").select("vec_id", "group_id", "group_size", "links", (F.col("vec_id") == F.col("group_id")).alias("kept"))


SQL = f"""
WITH RECURSIVE vectors AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), usual AS (
  SELECT len(e) AS size FROM vectors GROUP BY len(e) ORDER BY count(*) DESC, size DESC LIMIT 1
), near AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.e AS a_e, b.e AS b_e FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE len(a.e) = (SELECT size FROM usual) AND list_distance(a.e, b.e) <= {EPS}
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings WHERE vec_id IS NOT NULL
  UNION
  SELECT reach.vec_id, near.b FROM reach JOIN near ON near.a = reach.other
), grouped AS (
  SELECT vec_id, min(other) AS group_id FROM reach GROUP BY vec_id
), linked AS (
  SELECT a AS vec_id, count(DISTINCT b_e) AS links FROM near WHERE a_e <> b_e GROUP BY a
)
SELECT vec_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size, coalesce(links, 0) AS links, vec_id = group_id AS kept
FROM grouped LEFT JOIN linked USING (vec_id)
"""
