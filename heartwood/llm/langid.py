"""Language identification by interpolated Kneser-Ney character models.

One model of order ``ORDER`` for each language, over the characters of words
(text between white space, lower-cased, with a blank on either side). The
fitted probabilities lie in sorted arrays of 64-bit n-gram hashes, one array
for each order and one column for each language; a document gets the language
of the lowest cross-entropy per character, and is rejected ("und") if that is
above the language's calibrated limit for a text of this length. The limits
lie between held-out texts in the language and held-out texts in a language
that is unknown (each scored without the model of its own language), so that
texts with foreign or odd passages stay and texts in no known language go.

The models are fitted on at most ``TRAIN_PER_LANG`` labelled rows of each
language (a documented bound); half as many others calibrate the limits. Every
row, whole, is scored.

Words with digits belong to no language and aren't scored.

Defined results: null, empty or blank texts, and those of such words only, have no language: lang_id "und",
accepted false, cross_entropy null. Rows with a null doc_id are scored and
keep that null; repeated rows are each scored alike; ties between languages go
to the first by name. With no labelled row at all every document is rejected.
Only doc_id, text and lang are read, so other columns can't clash.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartwood.llm.common import as_string, encode_words, map_batches, mix64, segment_sums, slices, split_words

ORDER = 5
#: At most so many labelled rows of a language are fitted, and half as many more calibrate.
TRAIN_PER_LANG = 300
#: Where the limit lies between the held-out medians of the language (0) and of unknown languages (1), and how many deviations of a text's length come on top.
REJECT_SHARE = 0.75
REJECT_DEVIATIONS = 4.0
#: Distance of unknown languages where a single language leaves nothing to measure it by, in nats.
_APART = 1.5
_PAD = 32
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _grams(cps: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the ``order`` characters that end at each position; positions without so many hold other characters' hashes."""
    with np.errstate(over="ignore"):
        h = np.full(len(cps), np.uint64(order))
        for back in range(order - 1, -1, -1):
            shifted = np.zeros(len(cps), dtype=np.uint64)
            shifted[back:] = cps[: len(cps) - back]
            h = h * _MUL + shifted + np.uint64(1)
    return mix64(h)


@dataclass
class Layer:
    """N-grams of one order: interpolated probabilities; and as contexts of the next order: back-off weights."""

    keys: np.ndarray
    logp: np.ndarray
    context_keys: np.ndarray
    backoff: np.ndarray


@dataclass
class Model:
    langs: list[str]
    layers: list[Layer]
    floor: np.ndarray
    limit: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in a sorted array, -1 where a key is missing."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


def _kneser_ney(words: Counter, order: int) -> tuple[list[dict[str, float]], list[dict[str, float]], float]:
    """For n = 1..order: {n-gram: interpolated probability}, {context: back-off weight}; and the weight of the uniform floor."""
    counts: list[Counter] = [Counter() for _ in range(order + 1)]
    for w, k in words.items():
        s = f" {w} "
        for i in range(1, len(s)):
            for n in range(1, min(order, i + 1) + 1):
                counts[n][s[i - n + 1 : i + 1]] += k
    used: list[Counter] = [Counter() for _ in range(order + 1)]
    used[order] = counts[order]
    for n in range(order - 1, 0, -1):  # how many different characters come before; where a word begins there is none, and the count itself stands
        for g in counts[n + 1]:
            used[n][g[1:]] += 1
        for g, k in counts[n].items():
            if n > 1 and g[0] == " ":
                used[n][g] = k
    probs: list[dict[str, float]] = [{} for _ in range(order + 1)]
    weights: list[dict[str, float]] = [{} for _ in range(order + 1)]
    floor = 1.0
    for n in range(1, order + 1):
        ones, twos = sum(v == 1 for v in used[n].values()), sum(v == 2 for v in used[n].values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        total, kinds = defaultdict(float), Counter()
        for g, v in used[n].items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        weights[n - 1] = {c: d * kinds[c] / total[c] for c in total}
        if n == 1:
            floor = weights[0].get("", 1.0)
        for g, v in used[n].items():
            lower = probs[n - 1].get(g[1:], 0.0) if n > 1 else 1e-5
            probs[n][g] = max(v - d, 0) / total[g[:-1]] + weights[n - 1][g[:-1]] * lower
    return probs, weights, floor * 1e-5


def _hash_strings(grams: list[str], order: int) -> np.ndarray:
    if not grams:
        return np.zeros(0, dtype=np.uint64)
    cps = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return _grams(cps, order)[order - 1 :: order]


def fit(words: dict[str, Counter], order: int = ORDER) -> Model:
    """A model from {language: {word: count}}."""
    langs = sorted(words)
    fitted = [_kneser_ney(words[x], order) for x in langs]
    floor = np.log(np.array([max(f[2], 1e-12) for f in fitted] or [1e-12]))
    layers: list[Layer] = []
    model = Model(langs, layers, floor)
    for n in range(1, order + 1):
        grams = sorted(set().union(*(f[0][n] for f in fitted))) if fitted else []
        keys = _hash_strings(grams, n)
        by = np.argsort(keys)
        contexts = sorted(set().union(*(f[1][n - 1] for f in fitted))) if n > 1 and fitted else []
        ckeys = _hash_strings(contexts, n - 1) if n > 1 else np.zeros(0, dtype=np.uint64)
        cby = np.argsort(ckeys)
        backoff = np.array([[np.log(f[1][n - 1].get(c, 1.0)) for f in fitted] for c in contexts]).reshape(-1, len(langs))
        layer = Layer(keys[by], np.zeros((len(grams), len(langs))), ckeys[cby], backoff[cby].astype(np.float32))
        layers.append(layer)
        known = np.array([[f[0][n].get(g, 0.0) for f in fitted] for g in grams]).reshape(-1, len(langs))
        lower = np.zeros_like(known)
        if len(grams):  # where a language hasn't seen the n-gram it backs off, now rather than at every look-up
            cps = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            lower = _backed_off(model, cps, n)[n - 1 :: n]
        with np.errstate(divide="ignore"):
            layer.logp = np.where(known > 0, np.log(known), lower)[by].astype(np.float32)
    return model


def _backed_off(model: Model, cps: np.ndarray, n: int) -> np.ndarray:
    """Log-probabilities by order n - 1 with order n's back-off weight, for n-grams laid end to end."""
    size = len(model.langs)
    if n == 1:
        return np.broadcast_to(model.floor, (len(cps), size))
    lower = _look(model, cps, n - 1, np.full(len(cps), n - 1))
    previous = np.concatenate([[np.uint64(0)], _grams(cps, n - 1)[:-1]])
    at = _find(model.layers[n - 1].context_keys, previous)
    out = lower.copy()
    out[at >= 0] += model.layers[n - 1].backoff[at[at >= 0]]
    return out


def _look(model: Model, cps: np.ndarray, order: int, depth: np.ndarray) -> np.ndarray:
    """Log-probability of each character given up to order - 1 before it, of which ``depth`` - 1 lie within the word."""
    out = np.zeros((len(cps), len(model.langs)), dtype=np.float32)
    todo = np.ones(len(cps), dtype=bool)
    for n in range(order, 0, -1):
        hashes = _grams(cps, n)
        may = np.flatnonzero(todo & (depth >= n))
        at = _find(model.layers[n - 1].keys, hashes[may])
        hit = may[at >= 0]
        out[hit] += model.layers[n - 1].logp[at[at >= 0]]
        todo[hit] = False
        if n > 1:
            miss = may[at < 0]
            before = _grams(cps, n - 1)[miss - 1]
            c = _find(model.layers[n - 1].context_keys, before)
            out[miss[c >= 0]] += model.layers[n - 1].backoff[c[c >= 0]]
        else:
            out[np.flatnonzero(todo)] += model.floor.astype(np.float32)
    return out


def word_scores(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Negative log-probability of each word by each language, and the number of characters predicted."""
    if not words:
        return np.zeros((0, len(model.langs))), np.zeros(0, dtype=np.int64)
    joined = " " + " ".join(words) + " "
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(length + 1)  # the place of the blank after each word
    starts = ends - length
    place = np.arange(len(cps))
    depth = np.ones(len(cps), dtype=np.int64)
    depth[1:] = place[1:] - np.repeat(starts - 1, length + 1) + 1
    scores = -_look(model, cps, len(model.layers), depth).astype(np.float64)
    return np.add.reduceat(scores[1:], starts - 1, axis=0), length + 1


def score_batch(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character (nats) of each text by each language, and the number of characters; NaN without any."""
    flat, offsets = split_words(pc.utf8_lower(texts))
    codes, unique = encode_words(flat)
    scores, chars = word_scores(model, unique.to_pylist())
    spoken = ~pc.match_substring_regex(unique, "[0-9]").to_numpy(zero_copy_only=False)  # numbers, codes and keys belong to no language
    scores, chars = scores * spoken[:, None], chars * spoken
    n = segment_sums(chars[codes] if len(codes) else np.zeros(0, dtype=np.int64), offsets)
    total = segment_sums(scores[codes] if len(codes) else np.zeros((0, len(model.langs))), offsets)
    with np.errstate(divide="ignore", invalid="ignore"):
        return total / n[:, None], n


def limits(model: Model, lang: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """The highest cross-entropy accepted for a text of so many characters in this language."""
    return model.limit[lang] + REJECT_DEVIATIONS * np.sqrt(model.spread[lang] / np.maximum(chars, 1))


def calibrate(model: Model, texts: list[str], labels: list[str]) -> None:
    """Sets the limits from held-out texts: how they score by their own language, how by the others alone, and how that varies with length."""
    h, n = score_batch(model, pa.array(texts, pa.large_string()))
    lang = np.array([model.langs.index(x) if x in model.langs else -1 for x in labels], dtype=np.int64)
    fine = (n > 0) & (lang >= 0)
    h, n, lang = h[fine], n[fine], lang[fine]
    model.limit, model.spread = np.full(len(model.langs), 3.0), np.full(len(model.langs), 4.0)
    others = h.copy()
    others[np.arange(len(h)), lang] = np.inf
    unknown = np.median(others.min(1)) if len(h) and len(model.langs) > 1 else None
    for k in range(len(model.langs)):
        x, size = h[lang == k, k], n[lang == k]
        if len(x) < 8:
            continue
        centre = np.median(x)
        apart = unknown - centre if unknown is not None and unknown > centre else _APART
        model.limit[k] = centre + REJECT_SHARE * apart
        model.spread[k] = max(np.median((x - centre) ** 2 * size) * 1.4826**2, 0.5)


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, order: int = ORDER) -> Model:
    """Fits on rows drawn by hash from each language's labelled rows."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL AND trim(lang) <> '' AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    # a fixed order of the rows; the share of it that is drawn shrinks as the table grows
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30))
    share = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 1.6 * per_lang / v) * (1 << 30)))])[F.col("lang")] if sizes else F.lit(0.0)
    rows = labelled.where(draw < share).select("lang", "text", draw.alias("draw")).collect()
    by: dict[str, list] = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["draw"], r["text"])):
        by[r["lang"]].append(r["text"])
    words = {}
    held: list[tuple[str, str]] = []
    for lang, texts in by.items():
        c = words[lang] = Counter()
        keep = min(per_lang, max(1, len(texts) * 2 // 3))
        for t in texts[:keep]:
            c.update(t.lower().split())
        held += [(lang, t) for t in texts[keep : keep + per_lang // 2]]
    words = {k: c for k, c in words.items() if c}
    if not words:
        return Model([], [], np.zeros(0))
    model = fit(words, order)
    if model.langs:
        calibrate(model, [t for _, t in held], [x for x, _ in held])
    return model


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, lang_id, cross_entropy, accepted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array([*m.langs, "und"], dtype=object)
        for batch in batches:
            for part in slices(batch):
                texts = as_string(part.column("text"))
                if m.langs:
                    h, n = score_batch(m, texts)
                    best = np.where(n > 0, np.argmin(np.where(np.isnan(h), np.inf, h), axis=1), 0)
                    low = h[np.arange(len(h)), best]
                    with np.errstate(invalid="ignore"):
                        ok = (n > 0) & (low <= limits(m, best, n))
                else:
                    low, ok, best = np.full(len(texts), np.nan), np.zeros(len(texts), dtype=bool), np.zeros(len(texts), dtype=int)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names[np.where(ok, best, len(m.langs))], pa.string()), pa.array(low, pa.float64(), mask=np.isnan(low)), pa.array(ok)],
                    ["doc_id", "lang_id", "cross_entropy", "accepted"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, lang_id string, cross_entropy double, accepted boolean")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with an accepted language, their columns as they were but for lang, which is the language found."""
    shared = spark.sparkContext.broadcast(train(docs))
    schema = docs.schema

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in slices(batch):
                if not m.langs:
                    continue
                h, n = score_batch(m, as_string(part.column("text")))
                best = np.where(n > 0, np.argmin(np.where(np.isnan(h), np.inf, h), axis=1), 0)
                with np.errstate(invalid="ignore"):
                    ok = (n > 0) & (h[np.arange(len(h)), best] <= limits(m, best, n))
                names = pa.array(np.array(m.langs, dtype=object)[best], pa.string())
                at = part.schema.get_field_index("lang")
                yield part.set_column(at, "lang", names.cast(part.schema.field(at).type)).filter(pa.array(ok))

    return map_batches(docs, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
