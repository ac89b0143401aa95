"""Every operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import textwrap
import time

import numpy as np
import pytest

from heartwood.llm import ego, html, langid, license_scan, mixing, permutation, pieces, pii, simhash, substring
from heartwood.llm.common import connected

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __source string, h long, spans int, group_id long"
WORDS = {"en": "the of and to in that is was for with as his they at be this from have or by", "de": "der die und das ist nicht ein ich auf mit den von sich des dem wird auch als an es"}


def prose(r, lang, n):
    return " ".join(r.choice(WORDS[lang].split()) + r.choice(["", "", r.choice(["ing", "ly"] if lang == "en" else ["ung", "keit"])]) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", 1, 2, 3) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, long, repeated rows, a null id, and columns whose names the operators use inside."""
    r = random.Random(3)
    long = prose(r, "en", 60_000)
    same = prose(r, "en", 120)
    rows = [(0, None, "en", "a"), (1, "", "en", "a"), (2, " \n\t ", None, None), (3, long, "en", "b"), (4, same, "en", "b"), (5, same, "en", "b"), (5, same, "en", "b"), (None, same, "en", "b")]
    return frame(spark, rows + [(10 + k, prose(r, lang, 80), lang, "c") for k in range(30) for lang in ["en", "de"][k % 2 : k % 2 + 1]])


def rows_of(df):
    return [tuple(x) for x in df.collect()]


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert not rows_of(substring.repeats(none)) and not rows_of(pieces.encode(none)) and not rows_of(simhash.groups(none)) and not rows_of(pii.scan(none))
    assert not rows_of(license_scan.scan(none)) and not rows_of(mixing.mixture(none)) and not rows_of(langid.identify(none, langid.train(none)))
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert not rows_of(ego.groups(v)) and not rows_of(permutation.neighbors(v, v))
    assert not rows_of(html.extract(spark.createDataFrame([], "page_id long, html string")))


def test_stages_keep_columns_on_odd_rows(spark, odd):
    for stage in (langid.stage, simhash.stage, pii.stage, mixing.stage):
        assert stage(spark, odd, "").columns == odd.columns
    assert stage(spark, odd.limit(0), "").count() == 0
    kept = simhash.stage(spark, odd, "").collect()
    assert sorted(x.doc_id for x in kept if x.doc_id is not None and x.doc_id < 10) == [0, 1, 2, 3, 4]
    assert sum(x.doc_id is None for x in kept) == 1


def brute_repeats(docs, size):
    where = {}
    for i, t in docs:
        w = (t or "").split()
        for k in range(len(w) - size + 1):
            where.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for i, t in docs:
        w = (t or "").split()
        hit = [k for k in range(len(w) - size + 1) if len(where[tuple(w[k : k + size])]) > 1]
        for k in hit:
            if k - 1 not in hit:
                end = k
                while end + 1 in hit:
                    end += 1
                out.append((i, k, end - k + size, min(where[tuple(w[k : k + size])])))
    return sorted(set(out))


def test_substring_dedup(spark):
    r = random.Random(1)
    unique = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    passage, short = unique(70), unique(49)
    docs = [(k, " ".join(unique(r.randrange(60)) + (passage if k % 3 else short) + unique(r.randrange(60)))) for k in range(12)]
    docs += [(12, " ".join(passage + unique(5) + passage)), (13, " ".join(passage[:55])), (14, None), (15, ""), (12, docs[0][1])]
    found = rows_of(substring.repeats(spark.createDataFrame(docs, "doc_id long, text string")))
    merged = [(i, " ".join(t for j, t in docs[:-1] if j == i and t)) for i in range(16)]
    mine = [x for x in found if x[0] not in (0, 12)]
    assert sorted(mine) == [x for x in brute_repeats(merged + [(12, docs[0][1])], 50) if x[0] not in (0, 12)]
    assert {x[0] for x in found} >= {0, 12}


def test_sentencepiece_matches_library(spark):
    spm = pytest.importorskip("sentencepiece")
    p = spm.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    r = random.Random(2)
    texts = ["", "a", "  two  blanks ", "naïve café 人人生 😀", "x" * 3000, prose(r, "de", 5000), "tab\tand\nline", "▁odd ▁", *("".join(r.choices("abc XYZ.ü1", k=r.randrange(80))) for _ in range(200))]
    rows = {x.doc_id: x for x in pieces.encode(spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")).collect()}
    assert rows[-1].ids is None and rows[-1].n_tokens == 0
    for k, t in enumerate(texts):
        assert rows[k].ids == p.encode(t), t[:50]
        assert rows[k].round_trip or "▁" in t


def test_stream_commits_within_a_window():
    with open(pieces.MODEL_PATH, "rb") as f:
        v = pieces.Vocabulary(f.read())
    s = pieces.Stream(v)
    text = ("▁" + "wordwithoutblanks" * 4000)[:60_000]
    first = s.feed(text)
    assert s.held < 12 * v.longest and len(first) > 1000  # committed on the way
    assert first + s.finish() == pieces.encode_text(v, text[1:])


def test_lockstep_and_stream_agree():
    with open(pieces.MODEL_PATH, "rb") as f:
        v = pieces.Vocabulary(f.read())
    r = random.Random(14)
    chunks = ["▁" + "".join(r.choices(["a", "b", "the", "ing", "ü", "人", "😀", "1", "x"], k=r.randrange(1, 90))) for _ in range(300)] + ["▁", "▁▁▁x"]
    flat, counts = pieces.Lockstep(v).encode(chunks)
    at = 0
    for c, n in zip(chunks, counts, strict=True):
        s = pieces.Stream(v)
        assert flat[at : at + n].tolist() == s.feed(c) + s.finish()
        at += n


def test_decode_is_the_way_back(spark):
    texts = ["", "a", "  two  blanks ", "naïve café 人人生 😀", prose(random.Random(15), "de", 500), None]
    encoded = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.text for r in pieces.decode(encoded).orderBy("doc_id").collect()] == texts


def components(n, near):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_embedding_dedup_matches_brute_force(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(0, 120, 3):
        x[k + 1] = x[k] + g.normal(size=8) * 0.03
    x[7] = x[200]
    rows = [(k, [float(v) for v in x[k]]) for k in range(300)] + [(900, None), (901, []), (902, [float("nan")] * 8), (903, [1.0] * 3), (None, [0.0] * 8), (5, [float(v) for v in x[5]])]
    rows += [(10**18 * 9 + k, [float(v) for v in g.normal(size=8) * 1e9]) for k in range(3)] + [(950, [1e9] * 8), (951, [1e9] * 7 + [1e9 + 0.1]), (960, [1e200] * 8), (961, [1e200] * 8)]
    found = rows_of(ego.groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), interval=64))
    got, links = {i: root for i, root, _ in found}, {i: n for i, _, n in found}
    assert (got[951], got[961]) == (950, 960) and links[950] == 1 and links[960] == 0 and all(got[10**18 * 9 + k] == 10**18 * 9 + k for k in range(3))
    for k in range(300):
        different = {tuple(x[j]) for j in range(300) if np.sqrt(((x[k] - x[j]) ** 2).sum()) <= ego.EPS} - {tuple(x[k])}
        assert links[k] == len(different)
    want = components(300, lambda i, j: np.sqrt(((x[i] - x[j]) ** 2).sum()) <= ego.EPS)
    assert [got[k] for k in range(300)] == want
    assert all(got[k] == k for k in range(900, 904)) and None not in got


def test_ego_skips_distant_blocks():
    x = np.sort(np.random.default_rng(1).uniform(size=(4000, 1)), axis=0)
    skipped = []
    found = sum(len(i) for i, _ in ego.joined(x, x, x, x, 0.001, skipped))
    assert sum(skipped) > 0.8 * 4000**2 / 2
    assert found == sum(np.searchsorted(x[:, 0], v + 0.001, side="right") - k - 1 for k, v in enumerate(x[:, 0]))


def test_nearest_neighbors_recall(spark):
    g = np.random.default_rng(5)
    x = np.concatenate([g.normal(size=(600, 32)), np.repeat(g.normal(size=(1, 32)), 40, axis=0)])
    rows = [(k, [float(v) for v in x[k]]) for k in range(len(x))] + [(9000, None), (9001, []), (9002, [float("inf")] * 32), (None, [0.0] * 32), (3, [float(v) for v in x[3]])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = permutation.neighbors(table, table, tile=128).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    limit = np.sort(d, axis=1)[:, permutation.K - 1]
    assert all(r.vec_id != r.neighbor_id and abs(r.distance - d[r.vec_id, r.neighbor_id]) < 1e-6 for r in got)
    assert len({(r.vec_id, r.rank) for r in got}) == len(got) == len({(r.vec_id, r.neighbor_id) for r in got})
    right = sum(r.distance <= limit[r.vec_id] + 1e-9 for r in got)
    assert right / (len(x) * permutation.K) >= 0.9


def true_neighbors(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k]


def test_nearest_neighbors_of_spread_rows(spark):
    g = np.random.default_rng(8)
    x = np.concatenate([np.repeat(g.normal(size=(98, 32)), 20, axis=0) + g.normal(size=(1960, 32)) * 0.01, g.normal(size=(40, 32))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = permutation.neighbors(table, table).collect()
    true = true_neighbors(x, permutation.K)
    spread = [r for r in got if r.vec_id >= 1960]
    assert len(spread) == 40 * permutation.K and sum(r.distance <= true[r.vec_id, -1] + 1e-9 for r in spread) >= 0.9 * len(spread)
    assert sum(r.distance <= true[r.vec_id, -1] + 1e-9 for r in got) >= 0.9 * len(x) * permutation.K


def test_nearest_neighbors_are_different_ids(spark):
    g = np.random.default_rng(9)
    x = g.normal(size=(300, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    near = [(7, (x[7] + g.normal(size=16) * 1e-4).tolist()) for _ in range(30)]  # many places of one id
    table = spark.createDataFrame(rows * 2 + [rows[3]] * 30 + near, "vec_id long, embedding array<double>")
    got = permutation.neighbors(table, table, tile=64).collect()
    assert sorted(got) == sorted(permutation.neighbors(table, table, tile=64, pivot_bytes=8 * 16 * 20).collect())  # pivots in four parts
    others = spark.createDataFrame([(10_000 + k, (x[k] + 1e-6).tolist()) for k in range(5)], "vec_id long, embedding array<double>")
    assert [r.neighbor_id for r in permutation.neighbors(others, table).where("rank = 1").orderBy("vec_id").collect()] == list(range(5))
    true = true_neighbors(x, permutation.K)
    assert len({(r.vec_id, r.neighbor_id) for r in got}) == len(got) == 300 * permutation.K
    assert sum(r.distance <= true[r.vec_id, -1] + 1e-2 for r in got) >= 0.9 * len(got)


def test_best_keeps_different_ids():
    q, o, d = np.zeros(14, dtype=int), np.array([1] * 10 + [2, 3, 4, 2]), np.array([0.1] * 10 + [0.3, 0.2, 0.4, 0.25])
    assert [(int(o[k]), float(d[k])) for k in permutation.best(q, o, d, 3)] == [(1, 0.1), (3, 0.2), (2, 0.25)]


def test_footrule_of_prefixes():
    g = np.random.default_rng(6)
    p = np.array([g.permutation(30)[:8] for _ in range(20)])
    place = lambda row: {int(v): k for k, v in enumerate(row)}
    for i, j in ((0, 1), (2, 3), (4, 4)):
        a, b = place(p[i]), place(p[j])
        foot = sum(abs(a.get(v, 8) - b.get(v, 8)) for v in {*a, *b})
        assert foot == 8 * 9 - 2 * permutation.shared_places(p, p)[i, j]


def test_mixing_quotas_and_tree(spark):
    q = mixing.quotas({"a": 100, "b": 50, "c": 7, "d": 5}, {"a": 2, "b": 1, "c": 0.1})
    assert q["d"] == 0 and q["a"] == 100 and abs(q["b"] - 50) <= 1 and q["c"] == 5
    s = mixing.split(np.array([100, 50, 5]), 7)
    assert (s.sum(0) == [100, 50, 5]).all() and np.ptp(s.sum(1)) <= 1
    r = random.Random(7)
    docs = spark.createDataFrame([(k, r.choice("aaab"), f"t{k}") for k in range(2000)] + [(None, None, "x"), (None, None, "x")], "doc_id long, source string, text string")
    got = mixing.mixture(docs, {"a": 1.0, "b": 1.0}, block=4, shard_blocks=40, bucket_rows=100).collect()
    ids = [x.doc_id for x in got]
    assert len(ids) == len(set(ids))
    n = [sum(x.source == s for x in got) for s in "ab"]
    assert abs(n[0] - n[1]) <= 8
    for k in {x.shard for x in got}:
        assert sorted(x.position for x in got if x.shard == k) == list(range(sum(x.shard == k for x in got)))
    again = mixing.mixture(docs.repartition(5), {"a": 1.0, "b": 1.0}, block=4, shard_blocks=40, bucket_rows=100).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mixing_scarce_source_gives_all_and_shrinks_no_other():
    for big, small in (({f"s{k}": 625_000 for k in range(20)}, {"": 1}), ({"hot": 6250} | {f"s{k}": 329 for k in range(19)}, {"": 1, "x": 2})):
        weights = {s: n**0.5 for s, n in (big | small).items()}
        alone, both = mixing.quotas(big, weights), mixing.quotas(big | small, weights)
        assert all(both[s] == n for s, n in small.items())
        assert all(abs(both[s] - alone[s]) <= 1 for s in big) and sum(both.values()) >= sum(alone.values())
    assert mixing.quotas({"a": 900, "b": 600, "c": 1}, {"a": 5, "b": 3, "c": 2}) == {"a": 900, "b": 540, "c": 1}


def brute_simhash(text):
    words = set(re.findall(r"[^\W_]+", text.lower()))
    bits = [int(hashlib.md5(w.encode()).hexdigest(), 16) for w in words]
    return len(words), sum(1 << j for j in range(128) if 2 * sum(b >> j & 1 for b in bits) > len(bits))


def test_simhash_groups_match_brute_force(spark):
    r = random.Random(8)
    base = [" ".join(f"w{r.randrange(4000)}" for _ in range(r.randrange(5, 150))) for _ in range(60)]
    texts = list(base)
    for t in base[:30]:
        w = t.split()
        for _ in range(max(1, len(w) // 40)):
            w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    got = dict(rows_of(simhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tile=16)))
    f = [brute_simhash(t) for t in texts]
    near = lambda i, j: f[i][1] == f[j][1] or ((f[i][1] ^ f[j][1]).bit_count() <= simhash.MAX_BITS and min(f[i][0], f[j][0]) >= simhash.MIN_RATIO * max(f[i][0], f[j][0]))
    assert [got[k] for k in range(len(texts))] == components(len(texts), near)


def test_connected_long_path(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100)]
    got = dict(rows_of(connected(spark.createDataFrame(pairs, "a long, b long"))))
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100}


def test_connected_ids_of_any_size(spark):
    far = 9_200_000_000_000_000_000
    got = dict(rows_of(connected(spark.createDataFrame([(far, far + 1), (far + 1, far + 2), (-far, far + 3)], "a long, b long"))))
    assert got == {far + 1: far, far + 2: far, far + 3: -far}


def test_pii_spans():
    texts = ["mail jo.doe@mail.example.com now", "call +1 (212) 555-0143 soon", "from 83.229.25.121 today", "card 4012888888881881 used", 'token = "73d74656391396c3efc1d06034ff67f14d7a089e" ok',
             "the year 1999-2003 in version 2.4.1 of order 12345678 and 100 000 people", "", "plain words only"]
    spans = pii.spans_of(texts, *pii.model())
    assert [[s[2] for s in x] for x in spans] == [["EMAIL"], ["PHONE"], ["IP"], ["CARD"], ["SECRET"], [], [], []]
    assert pii.redact(texts[0], spans[0]) == "mail [EMAIL] now"


def test_pii_long_secrets_are_redacted_to_their_end():
    r = random.Random(12)
    for n in (300, 513, 600, 1600, 20_000):
        key = pii._from(r, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", n)
        for text in (f'token = "{key}" ok', f"the key {key} ok", f"api_key={key}"):
            assert key in {text[a:b].removeprefix("api_key=") for a, b, _ in pii.candidates(text)}
            out = pii.redact(text, pii.spans_of([text], *pii.model())[0])
            assert not any(key[k : k + 12] in out for k in range(0, n - 12, 7)) and len(out) < 40
    began = time.monotonic()
    pii.candidates("=1" * 200_000 + "\u00e9 " + "a" * 400_000 + " " + "=a" * 200_000)
    assert time.monotonic() - began < 20


def test_pii_runs_match_the_expression_without_a_cap():
    r = random.Random(13)
    whole = re.compile(r"(?<![\w+/-])(?=[A-Za-z_+/=-]*[0-9])[A-Za-z0-9_+/=-]{20,}(?![\w+/=-])")
    for _ in range(2000):
        text = "".join(r.choices(["abcdefghij", "k", "=", "1", "+", " ", "\u00e9", "a" * 30, "."], weights=[6, 6, 4, 1, 1, 1, 1, 1, 1], k=40))
        want = [m.span() for m in whole.finditer(text)]
        got = [(a, b) for a, b, k in pii.candidates(text) if k == len(pii.GENERATORS) - 1]
        assert [a for a, _ in got] == [a for a, _ in want]


def test_pii_held_out():
    r = random.Random(99)
    hit = total = false = clean = 0
    for _ in range(1500):
        text, start, end, kind = pii._example(r)
        found = [s for s in pii.spans_of([text], *pii.model())[0] if s[0] < end and s[1] > start]
        total, hit = total + (kind is not None), hit + (kind is not None and bool(found))
        clean, false = clean + (kind is None), false + (kind is None and bool(found))
    assert hit / total > 0.95 and false / clean < 0.05


def test_pii_null_and_long(spark, odd):
    got = {x.doc_id: x for x in pii.scan(odd).collect()}
    assert got[0].text is None and got[0].spans == [] and got[1].text == "" and len(got[3].text) > 100_000


def test_html_blocks():
    nav = "<ul>" + "".join(f"<li><a href='#'>Link {k}</a></li>" for k in range(8)) + "</ul>"
    body = "".join(f"<p>{'word ' * 60}{k}</p>" for k in range(4))
    page = f"<html><head><title>A &amp; B</title><script>var x='</p>';</script></head><body>{nav}<h1>Head line</h1>{body}<p><a href='#'>more</a> <a href='#'>links</a></p></body></html>"
    title, n, kept, text = (x[0] for x in html.extract_batch([page]))
    assert title == "A & B" and "Link 3" not in text and text.count("word") == 240 and "var x" not in text and kept < n
    assert html.extract_batch(["", "<<<>", "<!-- open", "a < b"])[1] == [0, html.extract_batch(["<<<>"])[1][0], 0, 1]


def test_html_attributes_of_any_length():
    long = "a > b 'x' " * 3000
    page = lambda v: f'<html><head><title data-x="{v}">T</title></head><body><p>one two</p><img src="{v}"><div data-props="{v}">three <a href="{v}">four</a></div><script x="{v}">var y = "<p>no</p>";</script><svg d="{v}"><text>no</text></svg><p {"x=1 " * 5}>five</p></body></html>'
    assert html.blocks(page(long)) == html.blocks(page("v")) == ("T", [("one two", 2, 0), ("three four", 2, 1), ("five", 1, 0)])
    assert html.blocks("<p " + "a='b' " * 1000 + ">text</p>") == ("", [("text", 1, 0)])
    assert html.blocks('<p>x</p><b title="' + "y" * 9000)[1][0] == ("x", 1, 0)
    began = time.monotonic()
    for tail in ('"', "'\"", ""):
        html.Ends("").of(0)
        ends = html.Ends("<a b='c\" d" * 50_000 + tail)
        assert all(ends.of(k) >= -1 for k in range(0, len(ends.page), 11))
    assert time.monotonic() - began < 10


def test_html_links_across_blocks():
    assert html.blocks("<a href='x'><div>one two three four</div></a><p>five</p>")[1] == [("one two three four", 4, 4), ("five", 1, 0)]
    assert html.blocks("<p><a name='x'>one</p><p>two</p><p><a href='y'>three</a> four</p>")[1] == [("one", 1, 1), ("two", 1, 0), ("three four", 2, 1)]


def test_html_nulls(spark):
    got = html.extract(spark.createDataFrame([(1, None), (2, ""), (None, "<p>x</p>"), (3, "<p>" + "long " * 300_000)], "page_id long, html string")).collect()
    assert {x.page_id: (x.title, x.n_blocks) for x in got} == {1: ("", 0), 2: ("", 0), None: ("", 1), 3: ("", 1)}


def test_license_rules(spark):
    apache = "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" basis, without warranties or conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    texts = {1: apache, 2: "Intro.\nReleased under the MIT License.\nMore. All rights reserved.", 3: None, 4: "", 5: "nothing here", 6: "This Work is licensed under the GNU General Public License version 3."}
    got = {x.doc_id: x for x in license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {k: got[k].licenses for k in texts} == {1: "Apache-2.0", 2: "MIT,All-Rights-Reserved", 3: "", 4: "", 5: "", 6: "GPL-3.0"}
    assert got[1].sequence == "<=>" and got[1].n_sentences == 4


MIT_TEXT = "MIT License\n\nCopyright (c) 2020 Jo Doe\n\n" + 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD_TEXT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
GPL_TEXT = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
APACHE_TEXT = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'


def test_license_texts_that_are_wrapped(spark):
    wrapped = {k: "\n".join(f" * {line}".rstrip() for part in x.split("\n") for line in textwrap.wrap(part, 75) or [""]) for k, x in enumerate((MIT_TEXT, BSD_TEXT, GPL_TEXT, APACHE_TEXT))}
    texts = wrapped | {4: "Foo is released under the MIT license and comes with a manual.", 5: "Submit licenses; a permit license matters."}
    got = {x.doc_id: x for x in license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [got[k].licenses for k in range(6)] == ["MIT", "BSD-3-Clause", "GPL-3.0-or-later", "Apache-2.0", "MIT", ""]


def test_language_id(spark, odd):
    r = random.Random(9)
    train = frame(spark, [(k, prose(r, lang, 100), lang, "s") for k in range(120) for lang in ["en", "de"]])
    model = langid.train(train)
    test = [(k, prose(r, ["en", "de"][k % 2], 60), None, "s") for k in range(40)] + [(100, "".join(r.choices("qxzjkvwpb ", k=500)), None, "s"), (101, None, None, "s"), (102, "12 34", None, "s")]
    got = {x.doc_id: x for x in langid.identify(frame(spark, test), model).collect()}
    assert [got[k].lang_id for k in range(40)] == ["en", "de"] * 20
    assert all(got[k].lang_id == "und" and not got[k].accepted for k in (100, 101, 102)) and got[101].cross_entropy is None
    assert langid.identify(odd, model).count() == odd.count()


def test_kneser_ney_sums_to_one():
    probs, weights, floor = langid._kneser_ney(__import__("collections").Counter({"abab": 3, "abc": 2, "ca": 1}), 3)
    for n in (1, 2, 3):
        for c in {g[:-1] for g in probs[n]}:
            seen = {g[-1]: p for g, p in probs[n].items() if g[:-1] == c}
            rest = [g for g in probs[1] if g not in seen]

            def lower(ch, context):
                return probs[len(context) + 1].get(context + ch) or weights[len(context)].get(context, 1.0) * (lower(ch, context[1:]) if context else 1e-5)

            unseen = (10**5 - len(probs[1])) * lower("?", c)  # the alphabet has 100,000 characters, most of them never seen
            assert abs(sum(seen.values()) + sum(lower(x, c) for x in rest) + unseen - 1) < 0.001


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(10)
    same = prose(r, "en", 90)
    rows = [(k, prose(r, ["en", "de"][k % 2], 90) + f" mail a{k}.b@mail.example.com", ["en", "de"][k % 2], f"s{k % 2}") for k in range(60)] + [(200 + k, same, "en", "s0") for k in range(5)]
    docs = spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {x.doc_id for x in out}
    assert ids <= {i for i, *_ in rows} and len(ids) == len(out) and all(x.round_trip for x in out)
    assert not ids & {201, 202, 203, 204}
    with open(pieces.MODEL_PATH, "rb") as f:
        v = pieces.Vocabulary(f.read())
    assert all("@mail" not in pieces.decode_text(v, x.ids) for x in out)
