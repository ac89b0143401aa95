"""Personal data and secrets: candidate spans, boosted trees, calibrated thresholds.

High-recall generators propose overlapping spans (e-mail addresses, phone
numbers, IP addresses, card numbers, account and social numbers, secrets).
Boosted trees score each by its format and its context; a kind's threshold is
the lowest score, ``LEAST_SCORE`` at least, whose held-out precision is still ``PRECISION``. Accepted
spans that overlap are redacted together, under the kind of the best score.

The trees are trained on ``TRAIN_SPANS`` synthetic examples, drawn with a fixed
seed: real kinds and look-alikes (versions, dates, order numbers, amounts,
identifiers) in random context.

Defined results: a null text stays null and an empty one empty, both with no
spans; texts of any length are scanned whole; repeated rows are redacted
alike; offsets count characters of the text as it was.
Only doc_id and text are read by ``scan``; ``stage`` changes text and n_chars
and passes every other column on, whatever its name.
"""

from __future__ import annotations

import functools
import random
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from heartwood.llm import boost
from heartwood.llm.common import id_text, map_batches, slices

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "ACCOUNT", "SSN", "SECRET")
TRAIN_SPANS = 5000
PRECISION = 0.98
#: No span is redacted that the trees hold for less likely than this, however few look-alikes a kind's held-out examples had.
LEAST_SCORE = 0.5
_CONTEXT = 24
GENERATORS = (
    ("EMAIL", re.compile(r"(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)*+")),
    ("PHONE", re.compile(r"(?<![\w.])\+?\(?[0-9][0-9() ./-]{5,24}[0-9](?!\w)")),
    ("PHONE", re.compile(r"(?<![\w.])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?!\w)")),
    ("IP", re.compile(r"(?<![\w.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![\w])")),
    ("CARD", re.compile(r"(?<![\w])[0-9](?:[ -]?[0-9]){11,18}(?!\w)")),
    ("ACCOUNT", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("SSN", re.compile(r"(?<![\w-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![\w-])")),
    ("SECRET", re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"']{4,}+)")),
    ("SECRET", re.compile(r"[A-Za-z0-9_+/=-]{20,}+")),
)
#: Of the last generator: where in a run it can begin, and the last digit of the run, before which it must.
_RUN = len(GENERATORS) - 1
_BEGIN = re.compile(r"(?<![\w+/-])")
_LAST = re.compile(r"(?:[^0-9]*+[0-9]++)++")
_MARK = re.compile("=")
_WORD = re.compile(r"\w")
#: Texts without any of these can't hold a candidate.
TRIGGER = r"[0-9@]|(?i:token|secret|passw|pwd|key)"
_NEAR = (
    re.compile(r"(?i)\b(?:e-?mail|contact|write to)\b"),
    re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|sms)\b"),
    re.compile(r"(?i)\b(?:ip|host|server|address)\b"),
    re.compile(r"(?i)\b(?:card|visa|credit|payment|iban|account|bank)\b"),
    re.compile(r"(?i)\b(?:ssn|social security)\b"),
    re.compile(r"(?i)\b(?:token|secret|password|passwd|pwd|(?:api|access|private)?[_ -]?key|auth|bearer)\b"),
    re.compile(r"(?i)\b(?:version|release|build|licen[sc]e|v\.?)\s*$"),
    re.compile(r"(?i)\b(?:order|invoice|isbn|serial|article|item|no\.|id|commit|checksum|sha-?\d+)[: ]*$|#$"),
    re.compile(r"(?i)\b(?:date|year|born|since|total|price|pages?)\s*$|[$€]$"),
)


def _begin(text: str, start: int, end: int) -> int:
    """Where a run's candidate begins, at the run's own start or after a =, with a digit still to come; end if nowhere, or if a word goes on after the run."""
    digits = _LAST.match(text, start, end)
    if digits is None or _WORD.match(text, end):
        return end
    last = digits.end()
    if _BEGIN.match(text, start):
        return start
    return next((m.end() for m in _MARK.finditer(text, start, min(last, end - 20)) if _BEGIN.match(text, m.end())), end)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, generator) of every proposed span."""
    found = []
    for k, (_, pattern) in enumerate(GENERATORS):
        for m in pattern.finditer(text):
            start, end = m.span(1 if pattern.groups else 0)
            if k == _RUN:
                start = _begin(text, start, end)
            while end > start and text[end - 1] in ".,;:-":
                end -= 1
            if end > start:
                found.append((start, end, k))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def features(text: str, start: int, end: int, generator: int) -> list[float]:
    """Format of the span, and what stands around it."""
    span = text[start:end]
    n = len(span)
    digits = "".join(c for c in span if "0" <= c <= "9")
    groups = re.findall("[0-9]+", span)
    before, after = text[max(0, start - _CONTEXT) : start], text[end : end + _CONTEXT]
    kinds = [0.0] * len(GENERATORS)
    kinds[generator] = 1.0
    domain = span.rpartition("@")[2]
    counts = np.unique(np.frombuffer(span.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_counts=True)[1] / n
    return [
        *kinds,
        float(n),
        float(len(digits)),
        len(digits) / n,
        sum(c.isalpha() for c in span) / n,
        sum(c.isupper() for c in span) / n,
        sum(c in string.hexdigits for c in span) / n,
        float(-(counts * np.log2(counts)).sum()),
        float(len(digits) >= 12 and luhn(digits)),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float(bool(groups) and all(int(g[:9]) <= 255 for g in groups)),
        float(span[0] == "+"),
        float("(" in span),
        float(sum(c in " -/" for c in span)),
        float(span.count(".")),
        float("." in domain and domain.rpartition(".")[2].isalpha() and len(domain.rpartition(".")[2]) > 1),
        float(bool(re.fullmatch(r"(?:19|20)\d\d[-/. ]\d{1,2}[-/. ]\d{1,2}.*|\d{1,2}[-/. ]\d{1,2}[-/. ](?:19|20)\d\d.*", span))),
        float(len(groups) == 2 and len(groups[0]) == len(groups[1]) == 4),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(before[-1:] in ("\"", "'")),
        *[float(bool(p.search(before))) for p in _NEAR],
    ]


def _word(r: random.Random) -> str:
    return "".join(r.choices("etaoinshrdlu", k=r.randrange(2, 9)))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choices("0123456789", k=n))


def _from(r: random.Random, alphabet: str, n: int) -> str:
    return "".join(r.choices(alphabet, k=n))


def _example(r: random.Random) -> tuple[str, int, int, str | None]:
    """A text, the span that matters and its kind; None for a look-alike."""
    pick = lambda *x: r.choice(x)
    d = functools.partial(_digits, r)
    octet = lambda: str((r.randrange(1, 256)))
    kind = pick(*KINDS, *[None] * 6)
    cue = ""
    if kind == "EMAIL":
        span = f"{_word(r)}{pick('', '.', '_', '-', '+')}{pick(_word(r), d(2))}@{pick(_word(r), _word(r) + d(1), 'mail.' + _word(r))}.{pick('com', 'org', 'net', 'example.com', 'de', 'co.uk', 'io')}"
        cue = pick("", "", "mail ", "contact: ")
    elif kind == "PHONE":
        span = pick(f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{pick('44', '49', '33', '34')} {d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(11)}", f"0{d(3)} {d(7)}", f"+49 {d(2)} {d(4)} {d(4)}")
        cue = pick("", "", "", "phone ", "call ", "tel: ")
    elif kind == "IP":
        span = ".".join(octet() for _ in range(4))
        cue = pick("", "", "", "ip ", "host ")
    elif kind == "CARD":
        body = d(int(pick(16, 16, 16, 16, 15, 14)))
        span = pick(body, body, " ".join(body[i : i + 4] for i in range(0, len(body), 4)), "-".join(body[i : i + 4] for i in range(0, len(body), 4)))
        cue = pick("", "", "", "card ", "visa ")
    elif kind == "ACCOUNT":
        span = pick("DE", "FR", "ES", "GB", "NL") + d(2) + pick("", " ").join(["", *[d(4) for _ in range((r.randrange(3, 6)))], d(2)])
        cue = pick("", "iban ", "account ")
    elif kind == "SSN":
        span = f"{d(3)}-{d(2)}-{d(4)}"
        cue = pick("", "ssn ", "social security ")
    elif kind == "SECRET":
        span = pick(_from(r, "0123456789abcdef", int(pick(32, 40, 64))), _from(r, string.ascii_letters + string.digits, (r.randrange(20, 48))), "AKIA" + _from(r, string.ascii_uppercase + string.digits, 16), "ghp_" + _from(r, string.ascii_letters + string.digits, 36), "sk-" + _from(r, string.ascii_letters + string.digits, 40))
        cue = pick("token = \"", "token = \"", "api_key: ", "secret=", "password = '", "", "key ")
    else:
        span, cue = pick(
            (f"{r.randrange(1, 30)}.{r.randrange(0, 20)}.{r.randrange(0, 20)}.{r.randrange(0, 999)}", pick("version ", "v", "release ", "build ")),
            (f"{r.randrange(1990, 2031)}-{r.randrange(10, 13)}-{r.randrange(10, 29)}", pick("", "date ", "on ")),
            (f"{r.randrange(10, 29)}/{r.randrange(10, 13)}/{r.randrange(1990, 2031)}", pick("", "date ", "on ")),
            (f"{r.randrange(1900, 2031)}-{r.randrange(1900, 2031)}", pick("", "years ")),
            (d((r.randrange(7, 14))), pick("order ", "invoice ", "serial ", "item no. ", "#", "id ")),
            (f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", pick("ISBN ", "isbn: ")),
            (f"{r.randrange(1, 999)} {d(3)} {d(3)}", pick("total ", "$", "€ ", "")),
            (f"{d(4)}.{d(3)}.{d(4)}.{d(4)}", ""),
            (f"{_word(r)}@{_word(r)}", ""),
            ("-".join(_word(r) for _ in range(5)) + d(1), ""),
            ("/".join(_word(r) for _ in range(5)) + "/" + d(4), ""),
            (_word(r), pick("the key: ", "password: ", "token: ", "secret: ")),
            ("_".join(_word(r) for _ in range(4)) + d(2), ""),
            (_from(r, "0123456789abcdef", 40), pick("commit ", "sha1 ", "checksum: ")),
            (f"{d(3)}-{d(2)}-{d(4)}", pick("serial ", "order ", "item no. ")),
        )
    lead, tail = " ".join(_word(r) for _ in range((r.randrange(0, 4)))), " ".join(_word(r) for _ in range((r.randrange(0, 4))))
    head = f"{lead}{pick(' ', ' ', '. ', ', ') if lead else ''}{cue}"
    close = head[-1:] if head[-1:] in ("\"", "'") else ""
    return f"{head}{span}{close}{pick(' ', '. ', ', ') if tail else ''}{tail}", len(head), len(head) + len(span), kind


@functools.cache
def model(spans: int = TRAIN_SPANS, precision: float = PRECISION) -> tuple[boost.Boosted, np.ndarray]:
    """The trees, and the threshold of each generator."""
    r = random.Random(7)
    x, y, gen = [], [], []
    for _ in range(spans):
        text, start, end, kind = _example(r)
        for s, e, g in candidates(text):
            if e <= start or s >= end:
                continue
            x.append(features(text, s, e, g))
            y.append(kind == GENERATORS[g][0] and s <= start + 1 and e >= end - 1)
            gen.append(g)
    x, y, gen = np.array(x), np.array(y, dtype=float), np.array(gen)
    held = np.arange(len(y)) % 3 == 0
    trees = boost.fit(x[~held], y[~held])
    p = trees.predict(x[held])
    limits = np.full(len(GENERATORS), 0.5)
    for g in range(len(GENERATORS)):
        own = gen[held] == g
        score, truth = p[own], y[held][own]
        order = np.argsort(-score, kind="stable")
        right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= precision)
        if len(good):
            limits[g] = max(score[order][good[-1]], LEAST_SCORE)
    return trees, limits


def spans_of(texts: list[str], trees: boost.Boosted, limits: np.ndarray) -> list[list[tuple[int, int, str, float]]]:
    """For each text the redacted regions: start, end, kind, score; apart and in order."""
    found = [candidates(t) for t in texts]
    x = [features(t, *c) for t, cs in zip(texts, found, strict=True) for c in cs]
    out: list[list[tuple[int, int, str, float]]] = []
    p = trees.predict(np.array(x)) if x else np.zeros(0)
    at = 0
    for cs in found:
        mine = sorted((s, e, float(p[at + i]), g) for i, (s, e, g) in enumerate(cs) if p[at + i] >= limits[g])
        at += len(cs)
        merged: list[list] = []
        for s, e, score, g in mine:
            if merged and s < merged[-1][1]:
                m = merged[-1]
                m[1] = max(m[1], e)
                if score > m[3]:
                    m[2], m[3] = GENERATORS[g][0], score
            else:
                merged.append([s, e, GENERATORS[g][0], score])
        out.append([tuple(m) for m in merged])
    return out


def redact(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    parts, at = [], 0
    for s, e, kind, _ in spans:
        parts += [text[at:s], f"[{kind}]"]
        at = e
    return "".join([*parts, text[at:]])


def redact_batch(column: pa.Array, trees: boost.Boosted, limits: np.ndarray) -> tuple[pa.Array, list[list]]:
    """The texts with their spans replaced, and the spans of each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    maybe = pc.fill_null(pc.match_substring_regex(column, TRIGGER), False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(maybe)
    texts = column.take(pa.array(at)).to_pylist()
    found = spans_of(texts, trees, limits)
    hit = [k for k, f in enumerate(found) if f]
    spans: list[list] = [[] for _ in range(len(column))]
    for k in hit:
        spans[at[k]] = found[k]
    if hit:
        mask = np.zeros(len(column), dtype=bool)
        mask[at[hit]] = True
        column = pc.replace_with_mask(column, pa.array(mask), pa.array([redact(texts[k], found[k]) for k in hit], column.type))
    return column, spans


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans): the redacted text of every row, and what was redacted in it."""
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                text, spans = redact_batch(part.column("text"), *shared.value)
                rows = [[{"start": s, "end": e, "kind": k, "score": p} for s, e, k, p in x] for x in spans]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), text, pa.array(rows, _SPANS)], ["doc_id", "text", "spans"])

    return map_batches(id_text(docs), run, "doc_id long, text string, spans array<struct<start:int,end:int,kind:string,score:double>>")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their spans redacted; n_chars follows the text."""
    shared = spark.sparkContext.broadcast(model())

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                text, spans = redact_batch(part.column("text"), *shared.value)
                i, j = part.schema.get_field_index("text"), part.schema.get_field_index("n_chars")
                part = part.set_column(i, "text", text)
                if j >= 0 and any(spans):
                    mask = pa.array([bool(s) for s in spans])
                    length = pc.utf8_length(text).cast(part.schema.field(j).type)
                    part = part.set_column(j, "n_chars", pc.if_else(mask, length, part.column(j)))
                yield part

    return map_batches(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
