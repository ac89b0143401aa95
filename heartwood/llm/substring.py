"""Substring dedup: seed on winnowed anchors, extend both ways, keep maximal repeats.

Words are the runs between ASCII white space. Every ``MIN_WORDS`` consecutive
words hold at least one winnowed anchor, the least hash of ``ANCHOR_WORDS``
consecutive words, so texts that share a passage of MIN_WORDS words share an
anchor. Anchors that occur in two documents are the seeds; only documents with
seeds are read again. From each seed the match is extended to the left and to
the right, word by word, for as long as the MIN_WORDS words there occur in
another document too; what it reaches is a maximal repeat: it can't be made
longer on either side. Nothing is paired with anything, so a passage in a
million documents costs a million rows.

Result: (doc_id, start_word, n_words, first_doc_id), one row for each maximal
repeat of each document; start_word counts from 0, first_doc_id is the least
doc_id that has the repeat's first MIN_WORDS words (the row's own, where it is
the original).

Defined results: null, empty and shorter texts have no repeats; repeats within
one document only don't count, and rows with the same doc_id are one document;
rows with a null doc_id are left out; only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heartwood.llm.common import as_string, id_text, map_batches, mix64, slices

MIN_WORDS = 50
ANCHOR_WORDS = 25
_BYTE = 0x100000001B3
_WORD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and its inverse modulo 2**64 for k < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(p))
        have = _POWERS[base] = out[0], out[1]
    return have


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of values[start:end]."""
    up, down = _powers(base, len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((values + np.uint64(1)) * up[: len(values)], dtype=np.uint64)])
        return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words end to end, and the n + 1 offsets of each text's."""
    if not len(texts):
        return np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    word = ~_SPACE[raw]
    before, after = np.zeros(len(raw), dtype=bool), np.zeros(len(raw), dtype=bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    before[inner], after[inner - 1] = False, False  # a word ends with its text
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return _runs(raw.astype(np.uint64), starts, ends, _BYTE), np.searchsorted(starts, bounds)


def grams(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of ``size`` words of a text: its hash, its text's number and its place among all words."""
    room = np.maximum(0, np.diff(offsets) - size + 1)
    owner = np.repeat(np.arange(len(room)), room)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(room) - room, room) + np.repeat(offsets[:-1], room)
    return _runs(words, place, place + size, _WORD), owner, place


def _slide(x: np.ndarray, size: int, pick) -> np.ndarray:
    """pick over x[i:i + size] for every i for which that is whole."""
    have, step = x, 1
    while 2 * step <= size:
        have, step = pick(have[:-step], have[step:]), 2 * step
    rest = size - step
    return pick(have[: len(have) - rest], have[rest:]) if rest else have


def anchors(words: np.ndarray, offsets: np.ndarray, size: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The winnowed (hash, text number): for every ``window`` neighbouring grams of a text the least, ties included."""
    h, owner, _ = grams(words, offsets, size)
    if len(h) < window:
        return h[:0], owner[:0]
    least = _slide(h, window, np.minimum)
    least[owner[: len(least)] != owner[window - 1 :]] = 0  # runs over two texts choose nothing
    pad = np.zeros(window - 1, dtype=np.uint64)
    most = _slide(np.concatenate([pad, least, pad]), window, np.maximum)
    chosen = most == h
    return h[chosen], owner[chosen]


def seeds(docs: DataFrame, min_words: int, anchor_words: int) -> DataFrame:
    """(doc_id, seeds): for each document with any, the hashes of its anchors that another document has too."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words, offsets = word_hashes(as_string(part.column("text")))
                h, owner = anchors(words, offsets, anchor_words, min_words - anchor_words + 1)
                ids = part.column("doc_id").to_numpy()[owner]
                order = np.lexsort((h, owner))
                h, ids, owner = h[order], ids[order], owner[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(ids[new])], ["h", "doc_id"])

    same = Window.partitionBy("h")
    found = map_batches(docs, run, "h long, doc_id long").select("h", "doc_id", F.min("doc_id").over(same).alias("lo"), F.max("doc_id").over(same).alias("hi"))
    return found.where("lo < hi").groupBy("doc_id").agg(F.collect_set("h").alias("seeds"))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    docs = id_text(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    again = docs.join(seeds(docs, min_words, anchor_words), "doc_id")
    reach = min_words - anchor_words

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words, offsets = word_hashes(as_string(part.column("text")))
                h, owner, place = grams(words, offsets, anchor_words)
                lists = part.column("seeds")
                first = np.searchsorted(owner, np.arange(len(part) + 1))
                own, cuts = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                hit = np.zeros(len(h), dtype=bool)
                for k in range(len(part)):
                    hit[first[k] : first[k + 1]] = np.isin(h[first[k] : first[k + 1]], own[cuts[k] : cuts[k + 1]])
                # all places from which MIN_WORDS words take in a seed: the match is extended over these
                full, who, at = grams(words, offsets, min_words)
                seed, size = place[hit], len(words) + 2
                step = np.bincount(np.maximum(seed - reach, 0), minlength=size) - np.bincount(seed + 1, minlength=size)
                near = np.cumsum(step)[at] > 0
                start = (at - offsets[who])[near].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(full[near].view(np.int64)), pa.array(part.column("doc_id").to_numpy()[who[near]]), pa.array(start)], ["w", "doc_id", "start"])

    windows = map_batches(again.select("doc_id", "text", "seeds"), run, "w long, doc_id long, start int")
    same = Window.partitionBy("w")
    known = windows.select("doc_id", "start", F.min("doc_id").over(same).alias("lo"), F.max("doc_id").over(same).alias("hi")).where("lo < hi")
    row = Window.partitionBy("doc_id").orderBy("start")
    islands = known.withColumn("new", (F.col("start") - F.coalesce(F.lag("start").over(row), F.lit(-2)) > 1).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy("doc_id", "island").agg(F.min("start").alias("start_word"), (F.max("start") - F.min("start") + min_words).alias("n_words"), F.min(F.struct("start", "lo"))["lo"].alias("first_doc_id"))
    return out.select("doc_id", "start_word", "n_words", "first_doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), places AS (
  SELECT doc_id, w, unnest(range(len(w) - {MIN_WORDS - 1})) AS start FROM words WHERE len(w) >= {MIN_WORDS}
), windows AS (
  SELECT DISTINCT doc_id, start, md5(array_to_string(w[start + 1 : start + {MIN_WORDS}], ' ')) AS h FROM places
), known AS (
  SELECT doc_id, start, lo FROM (
    SELECT doc_id, start, min(doc_id) OVER (PARTITION BY h) AS lo, max(doc_id) OVER (PARTITION BY h) AS hi FROM windows
  ) WHERE lo < hi
), islands AS (
  SELECT doc_id, start, lo, start - row_number() OVER (PARTITION BY doc_id ORDER BY start) AS island
  FROM (SELECT doc_id, start, min(lo) AS lo FROM known GROUP BY doc_id, start)
)
SELECT doc_id, min(start)::int AS start_word, (max(start) - min(start) + {MIN_WORDS})::int AS n_words, arg_min(lo, start) AS first_doc_id
FROM islands GROUP BY doc_id, island
"""
