"""Columns of a file: name, content and what follows from them. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE_BYTES = 8192
MAX_FILE_CHARS = 8000

#: (suffix, language); an unlisted suffix has no language.
SUFFIXES = dict(
    p.split("=", 1)
    for p in (
        ".c=C|.cpp=C++|.h=C/C++ Header|.hpp=C++ Header|.go=Go|.rs=Rust|.swift=Swift|.kt=Kotlin|.java=Java|.cs=C#"
        "|.js=JavaScript|.jsx=JavaScript (React)|.ts=TypeScript|.tsx=TypeScript (React)|.py=Python|.rb=Ruby|.php=PHP|.ex=Elixir|.exs=Elixir"
    ).split("|")
)
#: Project files in the order in which they decide a directory's language.
PROJECT_FILES = [
    ("pyproject.toml", "Python"), ("requirements.txt", "Python"), ("Cargo.toml", "Rust"), ("package.json", "JavaScript/TypeScript"),
    ("go.mod", "Go"), ("pom.xml", "Java"), ("build.gradle", "Java/Kotlin"), ("Gemfile", "Ruby"), ("composer.json", "PHP"),
]


def literal_map(items: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in items.items() for x in kv])


def sentinel(label: str) -> Column:
    """The hash that stands for something without content, such as an unreadable file or a loop."""
    return F.concat(F.lit("sha256:"), F.sha2(F.lit(f"tree:{label}").cast("binary"), 256))


def is_text(content: Column) -> Column:
    """No NUL anywhere, and valid UTF-8 throughout."""
    return (F.instr(content.cast("string"), "\0") == 0) & F.is_valid_utf8(content.cast("string"))


def is_binary(content: Column) -> Column:
    """A NUL among the first bytes, or not valid UTF-8 as a whole; missing content counts as binary."""
    head = F.substring(content, 1, SAMPLE_BYTES).cast("string")
    return F.coalesce((F.instr(head, "\0") > 0) | ~F.is_valid_utf8(content.cast("string")), F.lit(True))


def unix_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def read_text(content: Column) -> Column:
    """Decoded text with universal newlines; null if it isn't UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), unix_newlines(content.cast("string")))


def file_hash(content: Column) -> Column:
    """SHA-256 after newline normalisation of text, of the bytes as they are otherwise; a sentinel if unreadable (null)."""
    normal = F.when(is_text(content), unix_newlines(content.cast("string")).cast("binary")).otherwise(content)
    return F.coalesce(F.concat(F.lit("sha256:"), F.sha2(normal, 256)), sentinel("error"))


def token_estimate(text: Column) -> Column:
    """A token for every four characters begun; 0 for an empty text."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("int")).cast("int")


def truncate(text: Column, chars: int = MAX_FILE_CHARS) -> Column:
    return F.substring(text, 1, chars)


def suffix(name: Column) -> Column:
    """The last dot and what follows, lower-cased; empty for names without one or with a leading dot only."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*(\.[^/.]+)$", 1))


def detect_language(name: Column) -> Column:
    return F.try_element_at(literal_map(SUFFIXES), suffix(name))


def binary_info(name: Column, size: Column) -> Column:
    """[binary: ext, size]"""
    ext = F.coalesce(F.nullif(F.substring(suffix(name), 2, 1000), F.lit("")), F.lit("unknown"))
    kb = F.concat(F.greatest(F.lit(1), F.ceil(size / 1024)).cast("string"), F.lit("KB"))
    tenths = F.bround(size / F.lit(1048576.0), 1)
    mb = F.concat(F.regexp_replace(F.format_string("%.1f", tenths), r"\.0$", ""), F.lit("MB"))
    return F.concat(F.lit("[binary: "), ext, F.lit(", "), F.when(size < 1048576, kb).otherwise(mb), F.lit("]"))


def collapse(text: Column) -> Column:
    """White space, line ends included, becomes single blanks."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def relative_path(path: Column, root: Column) -> Column:
    """'.' for the root itself, the whole path for what lies outside it."""
    below = F.concat(root, F.lit("/"))
    return F.when(path == root, ".").when(F.startswith(path, below), F.substr(path, F.length(below) + 1)).otherwise(path)
