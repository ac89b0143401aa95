"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search keeps, for each place in a text, the last piece of the best
segmentation that ends there, within a window no longer than the longest piece;
ids are committed whenever the backpointers of all places still in the window
lead through one boundary.

In a unigram model the best segmentation has the highest sum of scores. In a
BPE model it is the one that the merges produce: a piece can follow another if
merging their text gives just these two, and exactly one piece that ends at a
place can follow the best segmentation before it, so that the same search with
costs of 0 and infinity gives the merges' result.

A place between a character and a following blank, which no piece of the
vocabulary spans, is such a boundary in any text. Chunks between these are
looked up in a memo, so the search runs once for each different chunk. Chunks of
up to ``SHORT`` characters, no longer than a few windows, are searched many at
once, place by place (``Lockstep``); longer ones by ``Stream``. Both are the same
search with the same result for a chunk of any length, and are tested on the
same chunks.

``encode`` gives ids and whether they decode to the text; ``decode`` is the way
back for any table of ids.

Defined results: a null or empty text has no ids, a null one a null list;
texts of any length are encoded whole, in one pass; characters outside the
vocabulary become their bytes (or the unknown id); repeated rows are encoded
alike. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartwood.llm.common import KEPT, Probe, encode_words, id_text, map_batches, mix64, ragged, slices

#: The vocabulary that the queries use; the driver reads it and sends it to the executors.
MODEL_PATH = os.environ.get("HEARTWOOD_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
BLANK = "▁"
MEMO = 30_000
#: Chunks up to this length are searched in lockstep, so many at once; longer ones by ``Stream``.
SHORT = 64
LOCKSTEP = 10_000
#: Known pairs of pieces that are held at once.
PAIRS = 1_000_000
_LATER = 1 << 60


class Vocabulary:
    """Pieces of a model file, and for BPE what decides whether two may stand side by side."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.digest = hashlib.sha256(model).hexdigest()
        m = pb.ModelProto()
        m.ParseFromString(model)
        self.bpe = m.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.prefix = m.normalizer_spec.add_dummy_prefix
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only vocabularies that leave the text as it is are supported")
        kind = pb.ModelProto.SentencePiece
        self.ids: dict[str, int] = {}
        self.score: list[float] = []
        self.bytes = [-1] * 256
        self.unknown = 0
        raw = []
        for i, p in enumerate(m.pieces):
            self.score.append(p.score)
            raw.append(b"" if p.type == kind.CONTROL else p.piece.replace(BLANK, " ").encode())
            if p.type == kind.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                raw[-1] = bytes([int(p.piece[3:5], 16)])
            elif p.type == kind.UNKNOWN:
                self.unknown = i
                raw[-1] = " ⁇ ".encode()
            elif p.type in (kind.NORMAL, kind.USER_DEFINED):
                self.ids[p.piece] = i
        self.longest = max(map(len, self.ids), default=1)
        size = np.array([len(x) for x in raw], dtype=np.int64)
        self.text, self.text_size, self.text_start = np.frombuffer(b"".join(raw), dtype=np.uint8), size, np.cumsum(size) - size
        #: Whether a blank can come after another character inside a piece.
        self.inner_blank = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.least = min((self.score[i] for i in self.ids.values()), default=0.0)
        self.left: dict[int, list[tuple[str, int]]] = {}
        self.right: dict[int, list[tuple[str, int]]] = {}
        self.fits: dict[int, bool] = {}
        if self.bpe:
            order = sorted(self.ids.values(), key=lambda i: (-self.score[i], i))
            rank = {i: r for r, i in enumerate(order)}
            #: Equal scores share a rank: of these the leftmost merge comes first.
            tied: dict[float, int] = {}
            self.rank = {p: tied.setdefault(self.score[i], rank[i]) for p, i in self.ids.items()}
            for p, i in self.ids.items():
                tree = self._merge(p)
                if tree is not None:
                    self.left[i], self.right[i] = self._spine(tree, 2), self._spine(tree, 3)
        #: Every ending of a piece: the id where it is a piece that can occur itself, -1 otherwise.
        self.endings: dict[str, int] = {}
        for p, i in self.ids.items():
            for k in range(len(p)):
                self.endings.setdefault(p[k:], -1)
            if not self.bpe or i in self.left:
                self.endings[p] = i

    def _merge(self, piece: str):
        """The merges that make a piece: (text, time, left, right); None if they make something else."""
        nodes = [(c, -1, None, None) for c in piece]
        rank = self.rank
        while len(nodes) > 1:
            best, at = _LATER, -1
            for k in range(len(nodes) - 1):
                r = rank.get(nodes[k][0] + nodes[k + 1][0], _LATER)
                if r < best:
                    best, at = r, k
            if at < 0:
                return None
            a, b = nodes[at], nodes[at + 1]
            nodes[at : at + 2] = [(a[0] + b[0], max(best, a[1], b[1]), a, b)]
        return nodes[0]

    @staticmethod
    def _spine(tree, side: int) -> list[tuple[str, int]]:
        """From the outermost character up to the whole: each text, and when it is merged into the next."""
        out, later = [], _LATER
        while tree is not None:
            out.append((tree[0], later))
            later, tree = tree[1], tree[side]
        return out[::-1]

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the merges of both texts side by side end in just these two pieces."""
        left, right = self.right[a], self.left[b]
        rank, i, j = self.rank, 0, 0
        while True:
            (x, xt), (y, yt) = left[i], right[j]
            r = rank.get(x + y, _LATER)
            if r < xt and r <= yt and r < _LATER:
                return False
            if xt == yt == _LATER:
                return True
            if xt <= yt:
                i += 1
            else:
                j += 1

    def follows(self, a: int, b: int) -> bool:
        """``stay_apart``, remembered."""
        known = self.fits.get(a << 32 | b)
        if known is None:
            if len(self.fits) > 100_000:
                self.fits.clear()
            known = self.fits[a << 32 | b] = self.stay_apart(a, b)
        return known

    def byte_ids(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "replace")] if self.bytes[0] >= 0 else [self.unknown]


class Stream:
    """Feeds characters, commits ids. Holds the places since the last commit only."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""
        self.back = [0]  # length of the best last piece that ends at each place
        self.last = [-1]  # its id; -1 at a boundary, -2 for a character outside the vocabulary
        self.best = [0.0]
        self.held = 0  # most places held at once, for tests

    def feed(self, more: str) -> list[int]:
        out: list[int] = []
        limit = 4 * self.v.longest
        for k in range(0, len(more), limit):
            self._step(more[k : k + limit])
            if len(self.text) >= limit:
                out += self._commit(self._boundary())
        return out

    def finish(self) -> list[int]:
        return self._commit(len(self.text))

    def _step(self, more: str) -> None:
        v, start = self.v, len(self.text)
        text = self.text = self.text + more
        back, last, best, endings = self.back, self.last, self.best, v.endings
        fits, follows, score, bpe = v.fits, v.follows, v.score, v.bpe
        for end in range(start + 1, len(text) + 1):
            begin = end - 1
            top, piece, size = best[begin] + v.least - 10, -2, 1
            while begin >= 0 and (i := endings.get(text[begin:end])) is not None:
                if i >= 0:
                    if bpe:  # one piece at most fits here, and where one does the search is over
                        before = last[begin]
                        if before >= 0:
                            fit = fits.get(before << 32 | i)
                            if fit is None:
                                fit = follows(before, i)
                        if before < 0 or fit:
                            top, piece, size = 0.0, i, end - begin
                            break
                    elif (total := best[begin] + score[i]) > top:
                        top, piece, size = total, i, end - begin
                begin -= 1
            back.append(size)
            last.append(piece)
            best.append(top)
        self.held = max(self.held, len(text))

    def _boundary(self) -> int:
        """The last place that the best paths to all places a piece can still reach go through."""
        paths = set(range(max(0, len(self.text) - self.v.longest + 1), len(self.text) + 1))
        while len(paths) > 1:
            furthest = max(paths)
            paths.remove(furthest)
            paths.add(furthest - self.back[furthest])
        return paths.pop()

    def _commit(self, place: int) -> list[int]:
        out: list[list[int]] = []
        at = place
        while at > 0:
            out.append([self.last[at]] if self.last[at] >= 0 else self.v.byte_ids(self.text[at - 1]))
            at -= self.back[at]
        base = self.best[place]
        self.text = self.text[place:]
        # the piece before the boundary still decides what may follow it
        self.back, self.last = [0, *self.back[place + 1 :]], [self.last[place], *self.last[place + 1 :]]
        self.best = [b - base for b in self.best[place:]]
        return [i for piece in reversed(out) for i in piece]


def encode_text(v: Vocabulary, text: str) -> list[int]:
    """The ids of one text, without the memo."""
    if not text:
        return []
    s = Stream(v)
    return s.feed((BLANK if v.prefix else "") + text.replace(" ", BLANK)) + s.finish()


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _hashes(cps: np.ndarray, size: int, before: np.ndarray) -> np.ndarray:
    """Hashes of the last ``size`` characters at each place, from those of one fewer."""
    shifted = np.zeros(len(cps), dtype=np.uint64)
    shifted[size - 1 :] = cps[: len(cps) - size + 1]
    with np.errstate(over="ignore"):
        return before + mix64(shifted + np.uint64(size) * _STEP)


class Lockstep:
    """The search over many short chunks at once, one place of each at a time; for BPE vocabularies.

    The same window and rule as ``Stream``; every chunk ends at a boundary.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self.known = Probe(np.zeros(0), np.zeros(0))
        by: dict[int, list[tuple[str, int]]] = {}
        for e, i in v.endings.items():
            by.setdefault(len(e), []).append((e, i))
        self.endings = {}
        for size, found in by.items():
            cps = np.frombuffer("".join(e for e, _ in found).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            h = np.zeros(len(cps), dtype=np.uint64)
            for k in range(1, size + 1):
                h = _hashes(cps, k, h)
            h = h[size - 1 :: size]
            self.endings[size] = Probe(h, np.array([i for _, i in found], dtype=np.int64))

    def _fits(self, keys: np.ndarray) -> np.ndarray:
        out = self.known.get(keys, -1)
        if (out < 0).any():
            new = np.unique(keys[out < 0])
            follows = self.v.stay_apart
            if self.known.size > PAIRS:
                self.known = Probe(np.zeros(0), np.zeros(0))
                new = np.unique(keys)
            fit = np.fromiter((follows(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()), dtype=np.int64, count=len(new))
            self.known.add(new, fit)
            out = self.known.get(keys, -1)
        return out == 1

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks end to end, and how many each has."""
        v = self.v
        length = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        cps = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        ends = np.cumsum(length)
        depth = np.arange(1, len(cps) + 1) - np.repeat(ends - length, length)
        found_at, found_size, found_id = [], [], []
        live, h = np.arange(len(cps)), np.zeros(len(cps), dtype=np.uint64)
        outside = np.zeros(len(cps), dtype=bool)
        for size in range(1, v.longest + 1):
            if size > 1:
                keep = depth[live] >= size
                live, h = live[keep], h[keep]
            if not len(live):
                break
            with np.errstate(over="ignore"):
                h = h + mix64(cps[live - (size - 1)] + np.uint64(size) * _STEP)
            at = self.endings[size].get(h, -2)
            hit = at > -2
            if size == 1:
                outside[live[~hit]] = True
            live, h, at = live[hit], h[hit], at[hit]
            piece = at >= 0
            found_at.append(live[piece])
            found_id.append(at[piece])
            found_size.append(np.full(int(piece.sum()), size, dtype=np.int32))
        place, piece, size = np.concatenate(found_at), np.concatenate(found_id), np.concatenate(found_size)
        # index 0 of each chunk's run is its start: shift places by one for every chunk before
        slot = np.arange(len(cps)) + np.repeat(np.arange(1, len(chunks) + 1), length)
        base = len(v.score)
        last, back = np.full(len(cps) + len(chunks), -1, dtype=np.int64), np.ones(len(cps) + len(chunks), dtype=np.int64)
        odd, which = np.unique(cps[outside], return_inverse=True)
        last[slot[outside]] = base + which
        level = depth[place].astype(np.int16)
        order = np.argsort(level, kind="stable")
        place, piece, size, level = place[order], piece[order], size[order], level[order]
        cuts = np.searchsorted(level, np.arange(1, (int(length.max()) if len(length) else 0) + 2))
        to = slot[place]
        begin = to - size
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            before = last[begin[lo:hi]]
            ok = (before < 0) | (before >= base)
            inner = np.flatnonzero(~ok)
            ok[inner] = self._fits(before[inner] << 32 | piece[lo:hi][inner])
            ok = np.flatnonzero(ok)
            last[to[lo:hi][ok]], back[to[lo:hi][ok]] = piece[lo:hi][ok], size[lo:hi][ok]
        at, start = ends + np.arange(len(chunks)), ends - length + np.arange(len(chunks))
        rounds = []
        alive = np.flatnonzero(at > start)
        while len(alive):
            here = at[alive]
            rounds.append((alive, last[here]))
            at[alive] = here - back[here]
            alive = alive[at[alive] > start[alive]]
        number = np.zeros(len(chunks), dtype=np.int64)
        for alive, _ in rounds:
            number[alive] += 1
        tokens, stop = np.zeros(int(number.sum()), dtype=np.int64), np.cumsum(number)
        for r, (alive, t) in enumerate(rounds):  # the r-th from the end
            tokens[stop[alive] - 1 - r] = t
        owner = np.repeat(np.arange(len(chunks)), number)
        spelled = [v.byte_ids(chr(c)) for c in odd.tolist()]
        counts = np.array([1] * base + [len(x) for x in spelled], dtype=np.int64)
        values = np.array([*range(base), *(i for x in spelled for i in x)], dtype=np.int32)
        flat, per = ragged(values, np.cumsum(counts) - counts, counts, tokens)
        return flat, np.bincount(np.repeat(owner, per), minlength=len(chunks)).astype(np.int64)


_CHUNK = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


class Encoder:
    """Encodes batches of texts with a memo of chunks."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.memo: dict[str, bytes] = {}
        self.lockstep = Lockstep(v) if v.bpe else None

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk as int32 bytes."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        short = list(dict.fromkeys(c for c in chunks if c not in memo and len(c) <= SHORT)) if self.lockstep else []
        for k in range(0, len(short), LOCKSTEP):
            some = short[k : k + LOCKSTEP]
            flat, counts = self.lockstep.encode(some)
            raw, ends = flat.tobytes(), (4 * np.cumsum(counts)).tolist()
            memo.update(zip(some, map(lambda a, b: raw[a:b], [0, *ends[:-1]], ends), strict=True))
        out = []
        for c in chunks:
            known = memo.get(c)
            if known is None:
                s = Stream(self.v)
                known = np.array(s.feed(c) + s.finish(), dtype=np.int32).tobytes()
                if len(c) <= SHORT:
                    memo[c] = known
            out.append(known)
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the n + 1 offsets of each text's."""
        n = len(texts)
        if self.v.inner_blank or not self.v.prefix:
            each = [encode_text(self.v, t) for t in texts.to_pylist()]
            counts = np.array([len(x) for x in each], dtype=np.int64)
            return np.array([i for x in each for i in x], dtype=np.int32), np.concatenate([[0], np.cumsum(counts)])
        split = pc.split_pattern(texts, " ")
        words = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        codes, unique = encode_words(split.flatten())
        offsets = np.concatenate([[0], np.cumsum(words)])
        unique = unique.to_pylist()
        odd_words = np.array([not w or BLANK in w for w in unique], dtype=bool)
        ids = self.chunks([BLANK + w for w in unique])
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), dtype=np.int32)
        values, per = ragged(flat, np.cumsum(counts) - counts, counts, codes)
        ends = np.concatenate([[0], np.cumsum(per)])[offsets]
        if not odd_words.any():
            return values, ends
        # runs of blanks (or the character that stands for one) join the word after them: these texts are cut by the general rule
        odd = np.unique(np.searchsorted(offsets, np.flatnonzero(odd_words[codes]), side="right") - 1)
        parts = [values[ends[k] : ends[k + 1]] for k in range(n)]
        for k, t in zip(odd.tolist(), texts.take(pa.array(odd)).to_pylist(), strict=True):
            whole = self.chunks(_CHUNK.findall(BLANK + t.replace(" ", BLANK))) if t else []
            parts[k] = np.frombuffer(b"".join(whole), dtype=np.int32)
        size = np.array([len(p) for p in parts], dtype=np.int64)
        return np.concatenate(parts) if parts else values, np.concatenate([[0], np.cumsum(size)])


def _encoder(v: Vocabulary) -> Encoder:
    """This worker process's encoder: later tasks find the memo filled."""
    if "pieces" not in KEPT or KEPT["pieces"].v.digest != v.digest:
        KEPT["pieces"] = Encoder(v)
    return KEPT["pieces"]


def decode_batch(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and their offsets; the blank that encoding puts first is gone."""
    flat, per = ragged(v.text, v.text_start, v.text_size, ids.astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(per)])[offsets]
    if v.prefix:
        full = ends[1:] > ends[:-1]
        first = ends[:-1][full]
        keep = np.ones(len(flat), dtype=bool)
        keep[first[flat[first] == 32]] = False
        gone = np.zeros(len(ends), dtype=np.int64)
        gone[1:][full] = flat[first] == 32
        flat, ends = flat[keep], ends - np.cumsum(gone)
    return flat, ends


def decode_text(v: Vocabulary, ids: list[int]) -> str:
    flat, _ = decode_batch(v, np.array(ids, dtype=np.int32), np.array([0, len(ids)]))
    return flat.tobytes().decode("utf-8", "replace")


def encode(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): the ids of every text, and whether they decode to it byte by byte."""
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(f.read()))

    def run(batches):
        v = shared.value
        encoder = _encoder(v)
        for batch in batches:
            for part in slices(batch):
                column = part.column("text")
                missing = column.is_null()
                texts = pc.fill_null(column, "").cast(pa.large_string())
                size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
                ids, offsets = encoder.batch(texts)
                if len(texts):
                    ids, offsets = ids[offsets[0] :], offsets - offsets[0]
                empty = size == 0
                if empty.any():  # the dummy prefix of an empty text has been cut to nothing already
                    assert not np.diff(offsets)[empty].any()
                flat, ends = decode_batch(v, ids, offsets)
                raw = np.frombuffer(b"".join(texts.cast(pa.large_binary()).to_pylist()), dtype=np.uint8)
                same = np.diff(ends) == size
                if same.all():
                    wrong = np.flatnonzero(flat != raw)
                    same[np.searchsorted(ends, wrong, side="right") - 1] = False
                else:
                    starts = np.cumsum(size) - size
                    same = np.array([same[k] and bool((flat[ends[k] : ends[k + 1]] == raw[starts[k] : starts[k] + size[k]]).all()) for k in range(len(size))])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
                lists = pc.if_else(missing, pa.scalar(None, lists.type), lists) if missing.true_count else lists
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets).astype(np.int32)), lists, pa.array(same)], ["doc_id", "n_tokens", "ids", "round_trip"])

    return map_batches(id_text(docs), run, "doc_id long, n_tokens int, ids array<int>, round_trip boolean", keeps="pieces")


def decode(encoded: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, text): the texts of (doc_id, ids); null ids give a null text, and bytes that are no UTF-8 the replacement character."""
    with open(path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(f.read()))

    def run(batches):
        v = shared.value
        for batch in batches:
            column = batch.column("ids")
            missing = column.is_null().to_numpy(zero_copy_only=False)
            counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, ends = decode_batch(v, column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)]))
            texts = [None if gone else flat[a:b].tobytes().decode("utf-8", "replace") for gone, a, b in zip(missing, ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), run, "doc_id long, text string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
