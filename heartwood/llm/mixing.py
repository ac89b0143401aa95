"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are put in a random but fixed order (by a hash of id
and text) and cut into blocks of ``BLOCK`` consecutive ones, which are shared
out without repeating any document: exact quotas of blocks for each source
(largest remainders), split down a binary tree over the output shards, at each
node by one multivariate hypergeometric draw, so that the quotas of all shards
add up exactly. A scarce source never shrinks the others: it gives all it has,
and they keep their weights among themselves (``FILL``). A shard draws its
blocks, disjoint from all others', and shuffles their documents locally.

The driver holds one number for each source. The tree is split up on the
executors, ``FAN`` shards to a row, and leaves for each source the ranks at
which one shard's blocks end and the next one's begin; counts of hash buckets
and the hashes alone, no texts, turn these ranks into places in the order. A
document finds its shard by its own hash, so texts are moved once, straight to
their shards, and those that no shard draws aren't moved at all.

Defined results: a null source is the source ''; an empty table gives an empty
one; rows with a null doc_id are drawn as the separate rows they are; rows of
one source with the same doc_id and text have one place in the order and go to
one shard together or stay out together, so quotas can be off by their number;
a source without a weight gets none. ``stage`` passes all columns on, whatever
their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heartwood.llm.common import checked, cut, unused

SEED = 20_24
BLOCK = 8
SHARD_BLOCKS = 2_500
BUCKET_ROWS = 20_000
#: Shards of a subtree that one row of the distributed tree splits up.
FAN = 64
#: Output partitions; with more shards than this, neighbouring shards share one.
MAX_PARTITIONS = 1 << 15
#: Without given weights a source weighs its number of documents to this power.
TEMPERATURE = 0.5
#: The mixture grows until sources of more weight than the rest of this would fall short of their shares.
FILL = 0.5


def quotas(blocks: dict[str, int], weights: dict[str, float]) -> dict[str, int]:
    """Blocks of each source: its share of the mixture, or all it has if that is less, rounded by largest remainders.

    The mixture is the largest that sources of at least ``FILL`` of the weight can fill with their whole share.
    """
    w = {s: max(float(weights.get(s, 0.0)), 0.0) if blocks[s] else 0.0 for s in blocks}
    total = sum(w.values())
    if total <= 0:
        return dict.fromkeys(blocks, 0)
    w = {s: x / total for s, x in w.items()}
    size, short = 0.0, 0.0
    for s in sorted((s for s in w if w[s] > 0), key=lambda s: (blocks[s] / w[s], s)):
        size, short = blocks[s] / w[s], short + w[s]
        if short > 1 - FILL - 1e-9:
            break
    exact = {s: min(blocks[s], size * x) for s, x in w.items()}
    out = {s: min(blocks[s], math.floor(x + 1e-9)) for s, x in exact.items()}
    left = math.floor(sum(exact.values()) + 1e-9) - sum(out.values())
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s)):
        if left > 0 and out[s] < blocks[s] and w[s] > 0:
            out[s] += 1
            left -= 1
    return out


def _divide(lo: int, hi: int, quota: np.ndarray, total: int, shards: int, seed: int) -> tuple[int, np.ndarray]:
    """The middle of a node of the tree, and the blocks of each source that go to its left half."""
    mid = (lo + hi) // 2
    room = total * mid // shards - total * lo // shards
    return mid, np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(quota, room, method="marginals")


def split(quota: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources): blocks of each source in each shard. Row sizes differ by one at most; columns add up to the quotas."""
    out = np.zeros((shards, len(quota)), dtype=np.int64)
    todo = [(0, shards, quota.astype(np.int64))]
    while todo:
        lo, hi, q = todo.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid, left = _divide(lo, hi, q, int(quota.sum()), shards, seed)
        todo += [(lo, mid, left), (mid, hi, q - left)]
    return out


def runs(spark: SparkSession, names: list[str], quota: np.ndarray, shards: int, seed: int = SEED) -> DataFrame:
    """(src, block, shard): the block of a source at which a shard's run of blocks begins; shard -1 after the last."""
    total = int(quota.sum())

    def expand(batches):
        for batch in batches:
            for node in batch.to_pylist():
                done: list[tuple] = []
                todo = [(node["lo"], node["hi"], np.array(node["quota"], dtype=np.int64), np.array(node["start"], dtype=np.int64))]
                while todo:
                    lo, hi, q, start = todo.pop()
                    if hi - lo == 1 or (hi - lo) * FAN <= node["hi"] - node["lo"]:
                        done.append((lo, hi, q, start))
                        continue
                    mid, left = _divide(lo, hi, q, total, shards, seed)
                    todo += [(lo, mid, left, start), (mid, hi, q - left, start + left)]
                lists = lambda k: pa.array([x[k].tolist() for x in done], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()), lists(2), lists(3)], ["lo", "hi", "quota", "start"])

    schema = "lo long, hi long, quota array<long>, start array<long>"
    nodes = spark.createDataFrame([(0, shards, quota.tolist(), [0] * len(quota))], schema)
    width = shards
    while width > 1:  # a root, FAN subtrees, FAN * FAN ...
        nodes, width = nodes.mapInArrow(expand, schema), -(-width // FAN)
        if width > 1:
            nodes = nodes.repartition("lo")
    at = F.posexplode(F.arrays_zip("quota", "start")).alias("j", "q")
    source = F.element_at(F.lit(names), F.col("j") + 1) if names else F.lit("")
    ends = spark.createDataFrame([(s, int(q), -1) for s, q in zip(names, quota, strict=True)], "src string, block long, shard long")
    begun = nodes.select("lo", at).where("q.quota > 0").select(source.alias("src"), F.col("q.start").alias("block"), F.col("lo").alias("shard"))
    return begun.unionByName(ends)


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, str, int]:
    """The rows that are drawn, with one column more that holds their shard; the name of that column; and the number of shards."""
    spark = docs.sparkSession
    src = F.coalesce(F.col("source").cast("string"), F.lit(""))
    sizes = {r[0]: r[1] for r in docs.groupBy(src.alias("src")).count().collect()}
    names = sorted(sizes)
    weights = weights if weights is not None else {s: n**TEMPERATURE for s, n in sizes.items()}
    quota = quotas({s: -(-n // block) for s, n in sizes.items()}, weights)
    shards = max(1, -(-sum(quota.values()) // shard_blocks))
    name = {c: unused(f"{c}_of_mix", docs) for c in ("src", "place", "buckets", "bucket", "cuts", "shard")}
    # the order's leading bits choose a bucket of the source; counts of the buckets before give the rank of its first row
    buckets = spark.createDataFrame([(s, max(1, -(-n // bucket_rows))) for s, n in sizes.items()], f"{name['src']} string, {name['buckets']} long")
    buckets = checked(buckets, len(sizes))
    texts = [F.col("text")] if "text" in docs.columns else []
    rows = docs.withColumns({name["src"]: src, name["place"]: F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), *texts)}).join(buckets, name["src"])
    lead = F.shiftrightunsigned(name["place"], 33)
    rows = rows.withColumn(name["bucket"], F.shiftright(lead * F.col(name["buckets"]), 31))
    keys = rows.select(*[F.col(name[c]).alias(c) for c in ("src", "bucket", "place")]).withColumn("place", F.col("place").bitwiseXOR(F.lit(-(1 << 63))))  # in the order of its bits
    keys = cut(keys.groupBy("src", "bucket", "place").count())
    inside = Window.partitionBy("src", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("src").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = keys.groupBy("src", "bucket").agg(F.sum("count").alias("n")).withColumn("pos", F.coalesce(F.sum("n").over(before), F.lit(0)))
    begun = runs(spark, names, np.array([quota[s] for s in names], dtype=np.int64), shards, seed)
    # in the order of ranks, a run begins in the last bucket before it, and a bucket begins in the last run before it
    line = counts.selectExpr("src", "pos", "0 AS kind", "bucket", "pos AS first", "CAST(NULL AS long) AS shard").unionByName(begun.selectExpr("src", f"block * {block} AS pos", "1 AS kind", "CAST(NULL AS long) AS bucket", "CAST(NULL AS long) AS first", "shard"))
    line = line.select("src", "kind", "pos", F.coalesce("bucket", F.last("bucket", True).over(along)).alias("bucket"), F.coalesce("first", F.last("first", True).over(along)).alias("first"), F.coalesce("shard", F.last("shard", True).over(along)).alias("shard"))
    line = line.where("bucket IS NOT NULL").groupBy("src", "bucket").agg(F.collect_list(F.when(F.col("kind") == 1, F.struct((F.col("pos") - F.col("first")).alias("at"), "shard"))).alias("begun"), F.max(F.when(F.col("kind") == 0, F.coalesce("shard", F.lit(-1)))).alias("carried"))
    ranked = keys.withColumn("at", F.coalesce(F.sum("count").over(inside), F.lit(0))).join(line.where(F.size("begun") > 0).select("src", "bucket", "begun"), ["src", "bucket"])
    here = F.filter("begun", lambda r: (r["at"] >= F.col("at")) & (r["at"] < F.col("at") + F.col("count")))
    cuts = ranked.select("src", "bucket", "place", F.explode(here).alias("r")).groupBy("src", "bucket").agg(F.collect_list(F.struct("place", "r.at", "r.shard")).alias("cuts"))
    low = F.struct(F.lit(-(1 << 63)).alias("place"), F.lit(-1).cast("long").alias("at"), F.col("carried").alias("shard"))
    cuts = line.join(cuts, ["src", "bucket"], "left").select(F.col("src").alias(name["src"]), F.col("bucket").alias(name["bucket"]), F.array_sort(F.concat(F.array(low), F.coalesce("cuts", F.array().cast("array<struct<place:long,at:long,shard:long>>")))).alias(name["cuts"]))
    # buckets where nothing is drawn are left out, and with them their rows
    cuts = cut(cuts.where(F.exists(name["cuts"], lambda c: c["shard"] >= 0)))
    cuts = checked(cuts, cuts.select(F.sum(F.size(name["cuts"]))).first()[0] or 0)
    own = F.filter(name["cuts"], lambda c: c["place"] <= F.col(name["place"]).bitwiseXOR(F.lit(-(1 << 63))))
    drawn = rows.join(cuts, [name["src"], name["bucket"]]).withColumn(name["shard"], F.element_at(own, -1)["shard"]).where(F.col(name["shard"]) >= 0)
    return drawn.select(*[drawn[c] for c in docs.columns], name["shard"]), name["shard"], shards


def _local(docs: DataFrame, seed: int) -> F.Column:
    """A shard's own order."""
    return F.xxhash64(F.lit(seed + 1), F.col("doc_id").cast("long"), *([F.col("text")] if "text" in docs.columns else []))


def _to_shards(drawn: DataFrame, shard: str, shards: int) -> DataFrame:
    """Every shard whole in one partition, and as few shards as possible in each."""
    each = -(-shards // MAX_PARTITIONS)
    return drawn.repartitionById(-(-shards // each), F.floor(F.col(shard) / F.lit(each)).cast("int"))


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, **sizes: int) -> DataFrame:
    """(doc_id, source, shard, position, text) of every document drawn; without text where docs has none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *[F.col(c) for c in ("text",) if c in docs.columns])
    drawn, shard, _ = mixed(rows, weights, seed, **sizes)
    place = F.row_number().over(Window.partitionBy(shard).orderBy(_local(rows, seed), "doc_id")) - 1
    return drawn.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col(shard).alias("shard"), place.alias("position"), *[F.col(c) for c in ("text",) if c in rows.columns])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn, shard by shard, each shard in its local order."""
    drawn, shard, shards = mixed(docs)
    return _to_shards(drawn, shard, shards).sortWithinPartitions(shard, _local(docs, SEED)).select(*[drawn[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))
