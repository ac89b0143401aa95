"""SimHash near-duplicates by segment-popcount embedding and a grid range-join.

A text's fingerprint has 128 bits: bit j says whether more of its different
words have bit j of their MD5 set than not. Words are maximal runs of letters
and digits of the lower-cased text, each counted once, so that frequent words
don't make unrelated texts of one language alike.

The number of bits set in each segment of a fingerprint (a popcount) embeds it
in a small grid: the Manhattan distance of two embeddings never exceeds their
Hamming distance. Cells of the grid (size class of the text, popcounts of the
coarse segments) whose boxes are farther apart than the threshold are never
joined; inside joined cells, blocks sorted by their segment popcounts are
skipped by the same bound, and the pairs left are verified exactly.

Defined results:

- two documents are near-duplicates if their fingerprints differ in at most
  ``max_bits`` bits and the smaller has at least ``min_ratio`` of the other's
  number of different words; groups are the connected components;
- null, empty or wordless texts have no fingerprint and are groups of one;
- rows with the same doc_id are one document, of which ``stage`` keeps one row
  (the first by a hash of its text); rows with a null doc_id can't be named in a pair: they
  aren't in ``groups``, and ``stage`` keeps all of them;
- of each group the least doc_id stays; other columns, whatever their names,
  are never read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heartwood.llm.common import as_string, checked, connected, cut, encode_words, forest, id_text, map_batches, ragged, slices, split_words, unused

BITS = 128
MAX_BITS = 22
MIN_RATIO = 0.75
#: Segments of the embedding, and the coarse ones (sums of neighbouring segments) that make up the grid's cells.
SEGMENTS = 16
COARSE = 2
#: Rows of a tile: a pair of tiles is one task's work and takes a few seconds.
TILE = 40_000
WORD = re.compile(r"[^\W_]+")
_ENTRIES = 100_000


def words_md5(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For raw words (between white space): the digests of the different words in them, their index lists, and counts."""
    known: dict[str, int] = {}
    flat: list[int] = []
    counts = np.empty(len(words), dtype=np.int64)
    for i, raw in enumerate(words):
        w = raw.lower()
        found = (w,) if w.isalnum() else WORD.findall(w)
        for x in found:
            flat.append(known.setdefault(x, len(known)))
        counts[i] = len(found)
    digests = b"".join([hashlib.md5(w.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for w in known])
    return np.frombuffer(digests, dtype=np.uint8).reshape(-1, 16), np.array(flat, dtype=np.int64), counts


def fingerprint_batch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of different words of each text, and its fingerprint as two big-endian 64-bit halves."""
    flat, offsets = split_words(texts)
    codes, unique = encode_words(flat)
    digests, index, counts = words_md5(unique.to_pylist())
    starts = np.cumsum(counts) - counts
    word, per = ragged(index, starts, counts, codes)
    owner = np.repeat(np.repeat(np.arange(len(texts)), np.diff(offsets)), per)
    u = max(1, len(digests))
    key = np.unique(owner * u + word)
    owner, word = key // u, key % u
    n = np.bincount(owner, minlength=len(texts))
    ends = np.concatenate([[0], np.cumsum(n)])
    bits = np.unpackbits(digests, axis=1)
    sums = np.zeros((len(texts), BITS), dtype=np.int64)
    first = 0
    while first < len(texts):  # documents whose words together fill a bounded matrix; a larger document is added up in parts
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + _ENTRIES, side="right")) - 1)
        at = np.flatnonzero(n[first:last]) + first
        if len(at) == 1:
            lo, hi = ends[at[0]], ends[at[0] + 1]
            for k in range(lo, hi, _ENTRIES):
                sums[at[0]] += bits[word[k : min(hi, k + _ENTRIES)]].sum(0, dtype=np.int64)
        elif len(at):
            lo = ends[first]
            sums[at] = np.add.reduceat(bits[word[lo : ends[last]]], ends[at] - lo, axis=0, dtype=np.int32)
        first = last
    halves = np.packbits(2 * sums > n[:, None], axis=1).view(">u8").astype(np.uint64)
    return n, halves.reshape(-1, 2)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, f0, f1) of every row that has an id; n_words is 0 where there is no word."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                n, f = fingerprint_batch(as_string(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n.astype(np.int32)), pa.array(f[:, 0].view(np.int64)), pa.array(f[:, 1].view(np.int64))], ["doc_id", "n_words", "f0", "f1"]
                )

    return map_batches(id_text(docs).where("doc_id IS NOT NULL"), run, "doc_id long, n_words int, f0 long, f1 long")


def popcounts(f: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Bits set in each of the segments of (n, 2) fingerprints."""
    bits = np.unpackbits(f.astype(">u8").view(np.uint8).reshape(len(f), -1), axis=1)
    return bits.reshape(len(f), segments, -1).sum(2, dtype=np.int16)


def close_pairs(left: np.ndarray, right: np.ndarray, ln: np.ndarray, rn: np.ndarray, max_bits: int, min_ratio: float, block: int = 2048):
    """Blocks of index pairs within the distance; ``left is right`` gives each pair once.

    Both sides are sorted by segment popcounts and cut into blocks; a pair of
    blocks is skipped if the Manhattan distance of their boxes exceeds max_bits.
    """
    same = left is right

    def prepare(f, n):
        p = popcounts(f)
        order = np.lexsort((*p.T[::-1][:2], n))  # by size first: the windows of sizes are narrow
        p, size = p[order], n[order]
        cuts = np.arange(0, len(f), block)
        return order, f[order], size, np.minimum.reduceat(p, cuts), np.maximum.reduceat(p, cuts), size[cuts], size[np.minimum(cuts + block, len(f)) - 1], cuts

    lo_, lf, lsize, llo, lhi, lmin, lmax, lcuts = prepare(left, ln)
    ro_, rf, rsize, rlo, rhi, rmin, rmax, rcuts = (lo_, lf, lsize, llo, lhi, lmin, lmax, lcuts) if same else prepare(right, rn)
    for i, s in enumerate(lcuts):
        gap = np.maximum(0, np.maximum(llo[i] - rhi, rlo - lhi[i])).sum(1)
        near = (gap <= max_bits) & (np.minimum(lmax[i], rmax) >= min_ratio * np.maximum(lmin[i], rmin))
        for j in np.flatnonzero(near):
            if same and j < i:
                continue
            t = rcuts[j]
            b, bn = rf[t : t + block], rsize[t : t + block]
            for k in range(s, min(s + block, len(lf)), 64):
                a = lf[k : min(k + 64, s + block)]
                first = np.bitwise_count(a[:, :1] ^ b[None, :, 0])
                x, y = np.nonzero(first <= max_bits)
                if not len(x):
                    continue
                ok = first[x, y] + np.bitwise_count(a[x, 1] ^ b[y, 1]).astype(np.int64) <= max_bits
                x, y = x[ok] + k, y[ok]
                an, cn = lsize[x], bn[y]
                y = y + t
                ok = np.minimum(an, cn) >= min_ratio * np.maximum(an, cn)
                if same:
                    ok &= x < y
                if ok.any():
                    yield lo_[x[ok]], ro_[y[ok]]


def edges(nodes: DataFrame, max_bits: int = MAX_BITS, min_ratio: float = MIN_RATIO, tile: int = TILE) -> DataFrame:
    """(a, b): pairs of nodes that connect the same components as all pairs within the distance.

    nodes: (node, n_words, f0, f1), each fingerprint and size once.
    """
    spark = nodes.sparkSession
    width = max_bits + 1
    half = BITS // COARSE
    step = float(-np.log(min_ratio))
    cell = nodes.select(
        "*",
        F.floor(F.log(F.col("n_words").cast("double")) / F.lit(step) + F.lit(1e-9)).cast("int").alias("size_class"),
        *[(F.bit_count(f"f{k}") / F.lit(width)).cast("int").alias(f"c{k}") for k in range(BITS // half)],
    )
    counts = cell.groupBy("size_class", "c0", "c1").count()
    tiles = cut(counts.select("size_class", "c0", "c1", F.ceil(F.col("count") / tile).cast("int").alias("tiles")))
    one = tiles.select(*[F.col(c).alias(f"x_{c}") for c in tiles.columns])
    # a ratio within min_ratio moves a size class by one at most; two cells c apart in one coarse popcount are (c - 1) * width + 1 bits apart at least
    near = one.select("*", F.explode(F.array("x_size_class", F.col("x_size_class") + 1)).alias("size_class")).join(tiles, "size_class")
    apart = sum(F.greatest(F.lit(0), (F.abs(F.col(f"c{k}") - F.col(f"x_c{k}")) - 1) * width + 1).cast("int") for k in range(2))
    same_class = F.col("size_class") == F.col("x_size_class")
    ordered = ~same_class | (F.struct("x_c0", "x_c1") <= F.struct("c0", "c1"))
    cells = near.where((apart <= max_bits) & ordered).withColumn("same", same_class & (F.col("x_c0") == F.col("c0")) & (F.col("x_c1") == F.col("c1")))
    jobs = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("x_tiles") - 1)).alias("x_t")).select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t")).where("NOT same OR x_t <= t")
    job = F.xxhash64("x_size_class", "x_c0", "x_c1", "x_t", "size_class", "c0", "c1", "t").alias("job")
    jobs = jobs.withColumn("job", job)
    left = jobs.select("job", F.lit(0).alias("side"), F.col("x_size_class").alias("size_class"), F.col("x_c0").alias("c0"), F.col("x_c1").alias("c1"), F.col("x_t").alias("t"), "same")
    right = jobs.where("NOT (same AND x_t = t)").select("job", F.lit(1).alias("side"), "size_class", "c0", "c1", "t", "same")
    placed = cell.join(tiles, ["size_class", "c0", "c1"]).withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    work = placed.join(left.unionByName(right), ["size_class", "c0", "c1", "t"]).select("job", "side", "node", "n_words", "f0", "f1")

    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        order = np.argsort(side, kind="stable")
        node, n = group.column("node").to_numpy()[order], group.column("n_words").to_numpy()[order].astype(np.int64)
        f = np.stack([group.column(c).to_numpy()[order].view(np.uint64) for c in ("f0", "f1")], axis=1)
        k = int((side == 0).sum())
        if k < len(side):
            pairs = ((x, y + k) for x, y in close_pairs(f[:k], f[k:], n[:k], n[k:], max_bits, min_ratio))
        else:
            pairs = close_pairs(f, f, n, n, max_bits, min_ratio)
        found = forest(pairs, len(f))
        return pa.table({"a": pa.array(node[found[:, 0]]), "b": pa.array(node[found[:, 1]])})

    # every group is one task's work, whatever the number of bytes: spread over as many partitions as there are jobs to share
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return work.repartition(parts, "job").groupBy("job").applyInArrow(run, "a long, b long")


def groups(docs: DataFrame, max_bits: int = MAX_BITS, min_ratio: float = MIN_RATIO, tile: int = TILE) -> DataFrame:
    """(doc_id, group_id): every document's group, named by its least doc_id."""
    prints = cut(fingerprints(docs).distinct())
    nodes = cut(prints.where("n_words > 0").groupBy("f0", "f1", "n_words").agg(F.min("doc_id").alias("node")))
    alike = nodes.select(F.col("node").alias("a"), F.min("node").over(Window.partitionBy("f0", "f1")).alias("b")).where("a <> b")
    roots = connected(edges(nodes, max_bits, min_ratio, tile).unionByName(alike))
    named = nodes.join(roots, "node", "left").select("f0", "f1", "n_words", F.coalesce("root", "node").alias("root"))
    full = prints.where("n_words > 0").join(named, ["f0", "f1", "n_words"]).select("doc_id", F.col("root").alias("group_id"))
    return full.unionByName(prints.where("n_words = 0").select("doc_id", F.col("doc_id").alias("group_id"))).groupBy("doc_id").agg(F.min("group_id").alias("group_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay: one of each group, with their columns."""
    gone, spare, extra = (unused(x, docs) for x in ("gone", "spare", "extra"))
    key, text = F.col("doc_id").cast("long"), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0))
    losers = cut(groups(docs).where("doc_id <> group_id").select(F.col("doc_id").alias(gone)))
    kept = docs.join(checked(losers, losers.count()), key == F.col(gone), "left_anti")
    # ids that stand on several rows, rare ones: only these rows are compared, all others stay where they are
    twice = cut(docs.where("doc_id IS NOT NULL").groupBy(key.alias(spare)).count().where("count > 1").select(spare))
    n = twice.count()
    if not n:
        return kept
    several = checked(twice, n)
    rows = [c for c, t in docs.dtypes if not t.startswith("map")]
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(text, F.xxhash64(*[F.col(c) for c in rows])))
    rest = kept.join(several, key == F.col(spare), "left_semi").withColumn(extra, first).where(F.col(extra) == 1).drop(extra)
    return kept.join(several, key == F.col(spare), "left_anti").unionByName(rest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    g = groups(docs)
    sizes = g.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return g.join(sizes, "group_id").select("doc_id", "group_id", "group_size", (F.col("doc_id") == F.col("group_id")).alias("kept"))


SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS word
  FROM documents WHERE doc_id IS NOT NULL
), digests AS (
  SELECT doc_id, md5(word) AS h FROM words
), bits AS (
  SELECT doc_id, j, count(*) AS n,
         sum((('0x' || substr(h, (j // 4 + 1)::int, 1))::int >> (3 - j % 4)::int) & 1) AS ones
  FROM digests, range({BITS}) AS r(j) GROUP BY doc_id, j
), prints AS (
  SELECT doc_id, max(n) AS n, string_agg(CASE WHEN 2 * ones > n THEN '1' ELSE '0' END, '' ORDER BY j) AS f
  FROM bits GROUP BY doc_id
), near AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM prints a JOIN prints b ON a.doc_id <> b.doc_id
  WHERE hamming(a.f, b.f) <= {MAX_BITS} AND (least(a.n, b.n) >= {MIN_RATIO} * greatest(a.n, b.n) OR a.f = b.f)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL
  UNION
  SELECT reach.doc_id, near.b FROM reach JOIN near ON near.a = reach.other
), grouped AS (
  SELECT doc_id, min(other) AS group_id FROM reach GROUP BY doc_id
)
SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size, doc_id = group_id AS kept FROM grouped
"""
