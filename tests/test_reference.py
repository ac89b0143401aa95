"""The queries against their SQL on the smallest tables, and the parts that have no SQL."""

import hashlib
import os
from datetime import UTC, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from heartwood import registry
from heartwood.functions import files, manifests
from heartwood.operators import health, ignore, ledger, summaries, tree
from heartwood.sources.directory import DirectorySource, write_manifests
from heartwood.streaming import debounce

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted([plain(r[c]) for c in cols] for r in df.collect())
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    assert mine == sorted([plain(r[k]) for k in order] for r in rel.fetchall())


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()["x"]


def test_file_hash_and_binary(spark):
    sha = lambda b: "sha256:" + hashlib.sha256(b).hexdigest()
    h = lambda b: one(spark, files.file_hash, b, "binary")
    assert h(b"a\r\nb\rc") == sha(b"a\nb\nc") and h(b"") == sha(b"") and h(b"a\r\n\0") == sha(b"a\r\n\0") and h(b"\xff\r\n") == sha(b"\xff\r\n")
    assert h(None) == sha(b"tree:error")
    binary = lambda b: one(spark, files.is_binary, b, "binary")
    assert binary(b"a\0") and not binary(b"a" * 8192 + b"\0") and binary(b"a" * 9000 + b"\xff") and not binary("é".encode() * 5000) and binary(None)


def test_since():
    now = datetime(2024, 3, 10, 12, tzinfo=UTC)
    got = [ledger.parse_since(x, now) for x in ("12h", "7d", "1w", "1m", "2024-01-02", "2024-01-02T03:04:05", "junk", None)]
    assert got == ["2024-03-10T00:00:00", "2024-03-03T12:00:00", "2024-03-03T12:00:00", "2024-02-09T12:00:00", "2024-01-02T00:00:00", "2024-01-02T03:04:05", None, None]


def test_empty_board(spark):
    runs = ledger.record(spark.createDataFrame([], "seq long, ts string, repo string, provider string, model string, dirs_processed long, tokens_used long, est_cost_usd double, cache_hits long, cache_misses long"))
    assert ledger.board(runs).first().asDict() == {"run_count": 0, "total_dirs_processed": 0, "total_tokens_used": 0, "total_tokens_saved": 0, "total_cost_usd": 0.0, "total_cost_saved_usd": 0.0, "cache_hit_rate": 0.0}


def test_ignore_rules(spark):
    rules = ["*.tmp", "!keep.tmp", "build/", "/top.txt", "a/**/z", "x?[0-9].md"]
    cases = {("d/f.tmp", False): True, ("d/keep.tmp", False): False, ("build", True): True, ("build", False): False, ("s/build/k.txt", False): True, ("top.txt", False): True, ("d/top.txt", False): False,
             ("a/z", False): True, ("a/b/c/z", True): True, ("xy3.md", False): True, ("xyz.md", False): False, (".", True): False}
    rows = spark.createDataFrame([(*k, v) for k, v in cases.items()], "path string, is_dir boolean, want boolean")
    assert not rows.where(ignore.ignored(F.col("path"), F.col("is_dir"), rules) != F.col("want")).collect()


def test_manifest_round_trip(spark):
    fields = {"generated": "2024-01-01T00:00:00Z", "generator": "g", "model": "m", "content_hash": "sha256:x", "files": 1, "dirs": 2, "tokens_total": 3}
    text = manifests.render({k: F.lit(v) for k, v in fields.items()}, F.lit("# a\n\nb\n"))
    m = spark.range(1).select(manifests.parse(text).alias("m")).first()["m"].asDict()
    assert m == {"ok": True, **fields, "body": "# a\n\nb\n"}
    for bad in ("", "no front", "---\nmodel: x\n"):
        assert not one(spark, manifests.parse, bad)["ok"]
    assert one(spark, manifests.parse, None) is None


def test_validate_bullets(spark):
    body = "# p\n\nText.\n\n## Files\n- **a** — x\n- **a** — y\n- **b/** — z\nodd\n\n## Subdirectories\n- None\n- **d/** — s\n\n## Notes\n- None\n- n\n"
    rows = spark.range(1).select(manifests.validate(F.lit("p"), F.lit(body), F.lit(2), F.lit(1), F.array(F.lit("a"), F.lit("c")), F.array(F.lit("d"))).alias("i"))
    assert rows.first()["i"] == [
        "Files entry should not end with '/': b/", "Files section contains a malformed bullet: odd", "Files section contains duplicate entries: a", "Files section is missing real entries: c",
        "Files section lists nonexistent entries: b", "Subdirectories section contains an illegal None row.", "Notes section contains an illegal None row.",
    ]


def test_json_array():
    f = summaries.find_json_array
    assert f('["a  b", {"summary": "c"}]') == ["a b", "c"] and f('x [1 y ["z"] t') == ["z"] and f("{}") is None and f("[1]") is None and f(None) is None


def test_summarize_falls_back(spark):
    def short(directory, items):
        return [f"S {x['name']}" for x in items[:1]]

    rows = spark.createDataFrame([("d", n, "c") for n in "abc"], "directory string, name string, content string")
    assert sorted(r.summary for r in summaries.summarize(rows, short).collect()) == ["S a", "S b", "S c"]


def test_budget_window(spark):
    d = spark.createDataFrame([("a/b", 2, 60), ("a/c", 2, 50), ("a", 1, 10), (".", 0, 5)], "path string, depth int, tokens long")
    assert {r.path: r.runs for r in health.budget_cutoff(d, 100).collect()} == {"a/b": True, "a/c": True, "a": False, ".": False}


def test_directory_source_and_merkle(spark, tmp_path):
    (tmp_path / "a" / ".hid").mkdir(parents=True)
    (tmp_path / "a" / "__init__.py").write_bytes(b"x\r\n")
    (tmp_path / "e").mkdir()
    spark.dataSource.register(DirectorySource)
    rows = spark.read.format("directory").load(str(tmp_path))
    assert {r.path: r.is_dir for r in rows.collect()} == {".": True, "a": True, "a/.hid": True, "a/__init__.py": False, "e": True}
    hashes = rows.where("NOT is_dir").select("path", files.file_hash(F.col("content")).alias("hash"))
    got = {r.path: r.hash for r in tree.merkle(rows.select("path", "parent", "name", "depth", "is_dir"), hashes, 2).collect()}
    sha = lambda t: "sha256:" + hashlib.sha256(t.encode()).hexdigest()
    a = sha(f".hid:{sha('')}\n__init__.py:{sha(chr(120) + chr(10))}\n")
    assert got == {"a/.hid": sha(""), "e": sha(""), "a": a, ".": sha(f"a:{a}\ne:{sha('')}\n")}
    write_manifests(spark.createDataFrame([("a", "one"), (".", "two")], "path string, text string"), str(tmp_path))
    assert (tmp_path / "a" / "CONTEXT.md").read_text() == "one" and len(list(tmp_path.iterdir())) == 3


def test_stream_of_bursts(spark, tmp_path):
    rows = [("p", "2024-01-01 00:00:00"), ("p", "2024-01-01 00:00:00.4"), ("p", "2024-01-01 00:00:02"), ("q", "2024-01-01 00:01:00")]
    spark.createDataFrame(rows, "path string, ts string").select("path", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("path string, ts timestamp").parquet(f"{tmp_path}/in")
    q = debounce.bursts(stream, late="1 second").writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.path, r.events) for r in spark.table("fired").collect()) == [("p", 1), ("p", 2)]
