"""Declaration extractors over one source text for each document, with the names that a reader finds in it.

The tables hold no source files, so snippets stand in for them, in which every
declared name carries the document's number; the SQL gives the names written
out by hand. Some
rules take in more than a reader would: a Java record is a method too, and a
C# type before a brace a property.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartwood.functions import files
from heartwood.functions.declarations import by_language, declarations
from heartwood.sources.tables import table

SNIPPETS: dict[str, str] = {
    "js_ts": "export function load() {}\nexport async function save() {}\nexport const add = (a) => a\nexport let mul = function (a) {}\nfunction hidden() {}\nexport abstract class Store {}\nexport interface Shape {}\nexport type Id = string\nexport default load\n",
    "rust": "pub fn open() {}\npub(crate) async fn read() {}\nfn hidden() {}\npub struct Row;\npub enum Kind {}\npub trait Walk {}\nmod inner;\npub mod outer;\n",
    "go": "func Open(a int) {}\nfunc (r *Row) Close() {}\nfunc hidden() {}\ntype Row struct {}\nconst Max = 1\nconst (\n\tZeta = 2\n\tAlpha = 3\n\tlow = 4\n)\nvar Count int\n",
    "java": "public final class Store {\n  @Override\n  public String name() { return n; }\n  private void hidden() {}\n  public static <T> List<T> all(int k) { return null; }\n}\npublic interface Shape {}\npublic enum Kind { A }\npublic record Pair(int a, int b) {}\n",
    "csharp": "public sealed class Store {\n    public int Count { get; set; }\n    public async Task<int> Load(int k) { }\n    private void Hidden() { }\n}\npublic interface IShape { }\npublic struct Point { }\npublic enum Kind { A }\n",
    "kotlin": "fun open(a: Int) {}\nprivate suspend fun read() {}\ndata class Row(val a: Int)\ninterface Shape\nobject Store\nenum class Kind { A }\n",
    "ruby": "module Tree\n  class Node < Base\n    def self.load(a)\n    end\n    def empty?\n    end\n  end\nend\n",
    "php": "<?php\nfunction open($a) {}\nfinal class Store {\n    public static function load($a) {}\n    private function hidden() {}\n}\ninterface Shape {}\ntrait Walks {}\nenum Kind {}\n",
    "swift": "public func open(a: Int) {}\nprivate func hidden() {}\nfinal class Store {}\nstruct Row {}\nprotocol Shape {}\nenum Kind { case a }\n",
    "elixir": "defmodule Tree.Node do\n  defstruct [:a]\n  @type t :: map\n  @spec open(a) :: b\n  @callback walk(a) :: b\n  def open(a) do\n  end\n  def open(a, b) do\n  end\n  defp hidden(a) do\n  end\nend\n",
    "python": "import os\nclass Row:\n    def inner(self): ...\ndef open_it(a): ...\nasync def read(a): ...\n",
}
EXPECTED: dict[str, dict[str, str]] = {
    "js_ts": {"functions": "load,save,add,mul", "classes": "Store", "interfaces": "Shape", "types": "Id", "default_export": ""},
    "rust": {"functions": "open,read", "structs": "Row", "enums": "Kind", "traits": "Walk", "modules": "inner,outer"},
    "go": {"functions": "Open,Close", "types": "Row", "constants": "Alpha,Max,Zeta", "variables": "Count"},
    "java": {"classes": "Store", "interfaces": "Shape", "enums": "Kind", "records": "Pair", "methods": "name,all,Pair"},
    "csharp": {"classes": "Store", "interfaces": "IShape", "enums": "Kind", "structs": "Point", "records": "", "methods": "Load", "properties": "Store,Count,IShape,Point,Kind"},
    "kotlin": {"functions": "open,read", "classes": "Row", "interfaces": "Shape", "objects": "Store", "enums": "Kind"},
    "ruby": {"methods": "load,empty?", "classes": "Node", "modules": "Tree"},
    "php": {"functions": "open,load", "classes": "Store", "interfaces": "Shape", "traits": "Walks", "enums": "Kind"},
    "swift": {"functions": "open", "classes": "Store", "structs": "Row", "protocols": "Shape", "enums": "Kind"},
    "elixir": {"functions": "open", "modules": "Tree.Node", "structs": "Tree.Node", "types": "t", "specs": "open", "callbacks": "walk"},
    "python": {"classes": "Row", "functions": "open_it,read"},
}


MARK = "§"


def marked(language: str) -> str:
    """The snippet with a mark after every name that is expected in it; ``empty?`` takes it before its sign."""
    out = SNIPPETS[language]
    for name in sorted({n for names in EXPECTED[language].values() for n in names.split(",") if n}, key=len, reverse=True):
        stem = name.rstrip("?")
        out = re.sub(rf"(?<!\w){re.escape(stem)}(?![\w{MARK}.])", stem + MARK, out)
    return out


def extract(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """(doc_id, kind, names): one source for each document, in which every declared name carries its number."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    source = F.replace(F.lit(marked(language)), F.lit(MARK), F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", declarations(language, source).alias("m"))
    return rows.select("doc_id", F.explode("m").alias("kind", "found")).select("doc_id", "kind", F.array_join("found", ",").alias("names"))


def _query(language: str):
    return lambda spark, sf_dir: extract(spark, sf_dir, language)


def _named(names: str) -> str:
    return ",".join(f"{n.rstrip('?')}{MARK}{'?' * n.endswith('?')}" for n in names.split(",") if n)


def _sql(rows: dict[str, str]) -> str:
    values = ", ".join(f"('{k}', '{_named(v)}')" for k, v in rows.items())
    return f"SELECT doc_id, kind, replace(names, '{MARK}', CAST(doc_id AS VARCHAR)) AS names FROM documents CROSS JOIN (VALUES {values}) AS t(kind, names)"


#: A file's suffix, and the language that its content is in; the last two have no extractor.
_SUFFIXES = [(".tsx", "js_ts"), (".rs", "rust"), (".go", "go"), (".java", "java"), (".cs", "csharp"), (".kt", "kotlin"), (".rb", "ruby"), (".php", "php"), (".swift", "swift"), (".exs", "elixir"), (".py", "python"), (".c", "go"), (".txt", "go")]


def dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every extractor by the language of a file's name: documents take turns as files of all suffixes."""
    k, n = F.pmod(F.col("doc_id"), F.lit(len(_SUFFIXES))), F.col("doc_id").cast("string")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), n, pick([s for s, _ in _SUFFIXES])).alias("name"), F.replace(pick([marked(x) for _, x in _SUFFIXES]), F.lit(MARK), n).alias("text"))
    found = rows.select("doc_id", F.explode(by_language(files.detect_language(F.col("name")), F.col("text"))).alias("kind", "found"))
    return found.select("doc_id", "kind", F.array_join("found", ",").alias("names"))


def _dispatched_sql() -> str:
    rows = ", ".join(f"({i}, '{kind}', '{_named(names)}')" for i, (_, x) in enumerate(_SUFFIXES[:11]) for kind, names in EXPECTED[x].items())
    return f"SELECT doc_id, kind, replace(names, '{MARK}', CAST(doc_id AS VARCHAR)) AS names FROM documents JOIN (VALUES {rows}) AS t(k, kind, names) ON doc_id % {len(_SUFFIXES)} = k"


QUERIES = {"extract_by_language": dispatched} | {f"extract_{x}": _query(x) for x in SNIPPETS}
SQL = {"extract_by_language": _dispatched_sql()} | {f"extract_{x}": _sql(EXPECTED[x]) for x in SNIPPETS}
