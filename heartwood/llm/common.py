"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a Python worker holds in its arrays at once. Texts are never cut: one longer than this is a slice of its own.
SLICE_BYTES = 3 << 20
#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20

M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset a local master, as in tests, gets a temporary one; on a cluster it is an error."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="heartwood-checkpoint-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that was written below the shared one."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder, which outlives any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of ids that are broadcast at most (some 50 MB); more are joined by a shuffle, with the same result.
BROADCAST_IDS = 1_000_000


def checked(ids: DataFrame, n: int) -> DataFrame:
    """``ids``, a table of n narrow rows: marked for broadcast if that is within the bound."""
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


#: What a reused Python worker keeps for its later tasks, by operator.
KEPT: dict[str, object] = {}


def _only(keeps: str) -> None:
    for name in [k for k in KEPT if k != keeps]:
        del KEPT[name]


def _give_back() -> None:
    """What Arrow and the allocator hold in reserve goes back to the machine: reused workers wait with little memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass


def map_batches(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, keeps: str = "") -> DataFrame:
    """``mapInArrow`` with batches of bounded size, which becomes the session's setting, and workers that give their memory back."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _only(keeps)
        yield from run(batches)
        _give_back()

    return rows.mapInArrow(tidy, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that the scans need, so that no other column is read or can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def as_string(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Text as a 64-bit offset array without nulls (null becomes the empty text)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each, one row at least."""
    n = batch.num_rows
    if not n:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    start = 0
    while start < n:
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def split_words(texts: pa.Array, *, ascii_only: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The words between white space, flat, and the n + 1 offsets of each text's words."""
    split = pc.ascii_split_whitespace(texts) if ascii_only else pc.utf8_split_whitespace(texts)
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten()
    full = np.not_equal(pc.binary_length(flat).to_numpy(zero_copy_only=False), 0)
    if not full.all():
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[full], minlength=len(counts)).astype(np.int64)
        flat = flat.filter(pa.array(full))
    return flat, np.concatenate([[0], np.cumsum(counts)])


def encode_words(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, and the different words."""
    d = pc.dictionary_encode(flat)
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def ragged(values: np.ndarray, starts: np.ndarray, counts: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values[starts[p]:starts[p] + counts[p]]`` for each p of picks, end to end; and the number of values for each pick."""
    n = counts[picks]
    total = int(n.sum())
    if not total:
        return values[:0], n
    ends = np.cumsum(n)
    at = np.arange(total) - np.repeat(ends - n, n) + np.repeat(starts[picks], n)
    return values[at], n


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads close numbers (public-domain constants)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]] along the first axis; empty segments give zero."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), dtype=values.dtype if values.dtype.kind == "f" else np.int64)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0, dtype=out.dtype)
    return out


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node that each node reaches, by rounds of large-star and small-star.

    Every round is two grouped minima over the edges and ends in the checkpoint folder;
    the rounds needed grow with the logarithm of the longest path.
    """
    lo, hi = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    e = cut(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").select(lo, hi).distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("n").agg(F.min("m").alias("root"))

    before = None
    while True:
        both = e.selectExpr("u AS n", "v AS m").unionByName(e.selectExpr("v AS n", "u AS m"))
        roots = least(both).select("n", F.least("n", "root").alias("root"))
        large = both.join(roots, "n").where("m > n").selectExpr("root AS u", "m AS v").where("u <> v").distinct()
        down = large.selectExpr("v AS n", "u AS m")
        small = down.join(least(down), "n").selectExpr("root AS u", "m AS v").where("u <> v")
        e = cut(small.select(lo, hi).unionByName(least(down).selectExpr("root AS u", "n AS v")).distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()  # no sum: ids may be any 64-bit numbers
        if now == before:
            return e.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))
        before = now


def unused(name: str, *frames: DataFrame) -> str:
    """``name`` with as many underscores before it as make it no column of the frames, in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def forest(pairs: Iterable[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """(k, 2) links between 0..n-1 that connect what the pairs connect: n - 1 at most, however many pairs there are."""
    root = np.arange(n)
    kept = [np.zeros((0, 2), dtype=np.int64)]
    for x, y in pairs:
        x, y = root[x], root[y]
        while (apart := x != y).any():
            x, y = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
            order = np.lexsort((x, y))
            x, y = x[order], y[order]
            first = np.ones(len(y), dtype=bool)
            first[1:] = y[1:] != y[:-1]
            kept.append(np.stack([x[first], y[first]], axis=1))
            root[y[first]] = x[first]
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
            x, y = root[x], root[y]
    return np.concatenate(kept)


class Probe:
    """A map from 64-bit keys to numbers, looked up for whole arrays: open addressing by the mixed key's leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.size = 0
        self._build(keys.astype(np.uint64), values.astype(np.int64))

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.values = np.zeros(1 << self.bits, dtype=np.int64)
        self.full = np.zeros(1 << self.bits, dtype=bool)
        self.size = 0
        self._put(keys, values)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot, mask = self._slot(keys), (1 << self.bits) - 1
        todo = np.arange(len(keys))
        self.size += len(keys)
        while len(todo):
            free = todo[~self.full[slot[todo]]]
            own, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[own], self.values[own], self.full[own] = keys[put], values[put], True
            done = np.zeros(len(keys), dtype=bool)
            done[put] = True
            todo = todo[~done[todo]]
            slot[todo] = (slot[todo] + 1) & mask

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Different keys that it doesn't hold yet."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            old = self.keys[self.full], self.values[self.full]
            self._build(np.concatenate([old[0], keys.astype(np.uint64)]), np.concatenate([old[1], values.astype(np.int64)]))
        else:
            self._put(keys.astype(np.uint64), values.astype(np.int64))

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        keys = keys.astype(np.uint64)
        slot, mask = self._slot(keys), (1 << self.bits) - 1
        full = self.full[slot]
        out = np.where(full & (self.keys[slot] == keys), self.values[slot], missing)
        todo = np.flatnonzero(full & (self.keys[slot] != keys))
        while len(todo):
            at = slot[todo] = (slot[todo] + 1) & mask
            full, hit = self.full[at], self.keys[at] == keys[todo]
            out[todo[full & hit]] = self.values[at[full & hit]]
            todo = todo[full & ~hit]
        return out
