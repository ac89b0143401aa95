"""The pipeline's stages, one by one and together, against versions that do the same work in the plainest way."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from heartwood.llm import langid, mixing, pieces, pii, simhash

VOICES = {"en": "the of and to in that is was for with as his they at be this from have or by", "de": "der die und das ist nicht ein ich auf mit den von sich des dem wird auch als an es"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `offset` long, __rank long, __gone long, gone long, spare long, extra long, src_of_mix string, shard long"


def prose(r, lang, n):
    return " ".join(r.choice(VOICES[lang].split()) + r.choice(["", "", r.choice(["ing", "ly"] if lang == "en" else ["ung", "keit"])]) for _ in range(n))


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 1, 2, 3, 4, 5, 6, "x", 7) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(21)
    base = [(k, prose(r, ["en", "de"][k % 2], r.randrange(30, 120)), ["en", "de"][k % 2], f"s{min(k % 5, 2)}") for k in range(160)]
    near = [(1000 + k, " ".join(["changed", *base[k][1].split()[1:]]), base[k][2], "s0") for k in range(0, 40, 4)]
    copies = [(2000 + k, base[3][1], "de", "s1") for k in range(12)]
    odd = [(3000, None, "en", "s0"), (3001, "", "en", "s0"), (3002, "".join(r.choices("qxzjkvwpb ", k=600)), None, "s0"), (3003, prose(r, "en", 20_000), "en", None), (None, prose(r, "en", 60), "en", "s0")]
    private = [(4000 + k, f"{prose(r, 'en', 40)} write to jo{k}.doe@mail.example.com or +1 (212) 555-01{k:02d} {prose(r, 'en', 20)}", "en", "s2") for k in range(20)]
    return base + near + copies + odd + private + [base[7]] * 2


def plain_entropy(probs, weights, floor, text, order):
    """Cross-entropy per character of one language, by recursion from n-gram to n-gram."""

    def p(context, c):
        n = len(context) + 1
        if context + c in probs[n]:
            return probs[n][context + c]
        lower = p(context[1:], c) if context else floor
        return lower * weights[len(context)].get(context, 1.0) if context else floor

    bits, n = 0.0, 0
    for w in text.lower().split():
        if re.search("[0-9]", w):
            continue
        s = f" {w} "
        for i in range(1, len(s)):
            bits -= math.log(p(s[max(0, i - order + 1) : i], s[i]))
            n += 1
    return bits / n if n else None


def test_language_scores_match_plain_recursion(spark, rows):
    words = {x: Counter(w for _, t, lang, _ in rows if lang == x and t for w in t.lower().split()) for x in VOICES}
    model = langid.fit(words)
    model.limit, model.spread = model.floor * 0 + 99, model.floor * 0 + 1
    fitted = {x: langid._kneser_ney(words[x], langid.ORDER) for x in words}
    texts = [t for _, t, _, _ in rows[:12]] + ["Zebra quux der", "the th3 of", "ß é 人", "the " * 50]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, t in enumerate(texts):
        want = {x: plain_entropy(*fitted[x], t, langid.ORDER) for x in sorted(words)}
        best = min(want, key=lambda x: (want[x], x))
        assert abs(got[k].cross_entropy - want[best]) < 1e-3 and (got[k].lang_id == best or abs(want["en"] - want["de"]) < 1e-4)


def kept_by_simhash(rows):
    """Ids that stay: the least of each component of near-duplicates."""
    prints = {}
    for i, t, _, _ in rows:
        words = set(re.findall(r"[^\W_]+", (t or "").lower()))
        h = [int(hashlib.md5(w.encode()).hexdigest(), 16) for w in words]
        prints[i] = len(words), sum(1 << j for j in range(128) if 2 * sum(b >> j & 1 for b in h) > len(h))
    ids = sorted(i for i in prints if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            (m, f), (n, g) = prints[a], prints[b]
            if a < b and m and n and (f == g or ((f ^ g).bit_count() <= simhash.MAX_BITS and min(m, n) >= simhash.MIN_RATIO * max(m, n))):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) == i}


def test_simhash_stage_matches_brute_force(spark, rows):
    kept = simhash.stage(spark, corpus(spark, rows), "").collect()
    want = kept_by_simhash(rows)
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(want) and sum(r.doc_id is None for r in kept) == 1
    texts = {i: t for i, t, _, _ in rows}
    assert all(r.text == texts[r.doc_id] and r["offset"] == 1 and r.gone == 4 and r.src_of_mix == "x" for r in kept)


def test_pii_stage_matches_text_by_text(spark, rows):
    model = pii.model()
    got = {r.doc_id: r for r in pii.stage(spark, corpus(spark, rows), "").collect()}
    for i, t, _, _ in rows:
        want = None if t is None else pii.redact(t, pii.spans_of([t], *model)[0])
        assert got[i].text == want and got[i].n_chars == (None if want is None else len(want)) and got[i].spare == 5
    assert not any("@mail" in (r.text or "") for r in got.values())


def test_mixing_stage_draws_the_quotas(spark, rows):
    docs = corpus(spark, rows)
    got = mixing.stage(spark, docs, "").collect()
    have = Counter(s or "" for _, _, _, s in rows)
    quota = mixing.quotas({s: -(-n // mixing.BLOCK) for s, n in have.items()}, {s: n**mixing.TEMPERATURE for s, n in have.items()})
    drawn = Counter(r.source or "" for r in got)
    assert all(abs(drawn[s] - min(have[s], quota[s] * mixing.BLOCK)) <= 3 for s in have)  # the row that stands there three times stays together
    assert not Counter(map(repr, got)) - Counter(map(repr, docs.collect()))


def test_mixing_tree_matches_the_plain_one(spark):
    names, quota = ["a", "b", "c"], __import__("numpy").array([900, 37, 5])
    for shards in (1, 2, 64, 65, 300):
        want, ends = mixing.split(quota, shards), [0, 0, 0]
        expected = set()
        for k in range(shards):
            for j in range(3):
                if want[k, j]:
                    expected.add((names[j], ends[j], k))
                    ends[j] += int(want[k, j])
        expected |= {(s, int(q), -1) for s, q in zip(names, quota, strict=True)}
        assert {tuple(r) for r in mixing.runs(spark, names, quota, shards).collect()} == expected


def test_whole_pipeline(spark, rows, tmp_path):
    spm = pytest.importorskip("sentencepiece")
    corpus(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:  # the stages alone, each on what the one before kept
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), SCHEMA)
    p = spm.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    want = sorted((r.doc_id or -1, p.encode(r.text)) for r in docs.collect())
    assert sorted((r.doc_id or -1, r.ids) for r in out) == want and len(out) > 50 and all(r.round_trip for r in out)
    ids = {r.doc_id for r in out}
    assert not ids & {3000, 3001, 3002} and len(ids & {3, *range(2000, 2012)}) <= 1


def test_empty_pipeline(spark, tmp_path):
    corpus(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
