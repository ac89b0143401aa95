"""Manifests: YAML front matter and a Markdown body, parsed, rendered and validated with built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MANIFEST = "CONTEXT.md"
FOOTER = "\n<!-- generated -->\n"
GENERATOR = "heartwood/1"
FIELDS = (("generated", "string"), ("generator", "string"), ("model", "string"), ("content_hash", "string"), ("files", "int"), ("dirs", "int"), ("tokens_total", "int"))
REQUIRED = tuple(k for k, _ in FIELDS)
_BULLET = "(?s)^- \\*\\*(.*?)\\*\\* — (.*)$"
_HEAD = r"(?s)\A[ \t]*---[ \t]*\n(.*?\n)?[ \t]*---[ \t]*(?:\n|\z)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often use names it, also inside of lambdas."""
    return F.transform(F.array(value), use)[0]


def scalar(value: Column) -> Column:
    """A text as YAML that reads back as the same text: plain where that is safe, in quotes otherwise."""
    plain = F.rlike(value, F.lit("^[A-Za-z_./][A-Za-z0-9_./:+@-]*$")) & ~F.endswith(value, F.lit(":")) & ~F.lower(value).isin("null", "true", "false", "yes", "no", "on", "off", "y", "n", ".inf", ".nan", ".", "..")
    escaped = F.rlike(value, F.lit(r"[\p{Cntrl}\x85\u2028\u2029]"))
    json = F.to_json(F.array(value))
    quoted = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(plain, value).when(escaped, F.substr(json, F.lit(2), F.length(json) - 2)).otherwise(quoted)


def unquoted(raw: Column) -> Column:
    """The text of a scalar on one line: quotes and escapes undone; of a plain one the comment is left out, and null is empty."""
    single = F.replace(F.regexp_extract(raw, r"^'((?:[^']|'')*)'\s*(?:#.*)?$", 1), F.lit("''"), F.lit("'"))
    double = F.from_json(F.concat(F.lit("["), F.regexp_extract(raw, r'^("(?:[^"\\]|\\.)*")\s*(?:#.*)?$', 1), F.lit("]")), "array<string>")[0]
    bare = F.trim(F.regexp_replace(raw, r"(^|\s+)#.*$", ""))
    return F.when(F.startswith(raw, F.lit("'")), single).when(F.startswith(raw, F.lit('"')), F.coalesce(double, F.lit(""))).when(bare.isin("null", "~", "Null", "NULL"), "").otherwise(bare)


def parse(text: Column, footer: str = FOOTER) -> Column:
    """struct<ok, the seven fields, body>; ok is false, and the rest null, for a text without front matter. A null text gives null."""
    plain = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    # front matter is a mapping: its first line that is no comment names a key
    ok = F.rlike(plain, F.lit(_HEAD)) & ~F.rlike(F.regexp_extract(plain, _HEAD, 1), F.lit(r"\A(?:[ \t]*(?:#[^\n]*)?\n)*[^\s#](?![^\n]*:(?:[ \t]|\n|\z))"))
    front = F.concat(F.lit("\n"), F.regexp_extract(plain, _HEAD, 1))

    def field(name: str, kind: str) -> Column:
        raw = F.trim(F.regexp_extract(front, rf"\n{name}:[ \t]*([^\n]*)", 1))
        value = unquoted(raw)
        if kind == "int":
            return F.coalesce(F.try_to_number(F.nullif(value, F.lit("")), F.lit("9999999999")).cast("int"), F.lit(0))
        if name == "generator":
            return F.when(F.contains(front, F.lit("\ngenerator:")), value).otherwise(GENERATOR)
        return value

    after = F.regexp_replace(plain, _HEAD, "")
    body = F.when(F.endswith(after, F.lit(footer)), F.substr(after, F.lit(1), F.length(after) - len(footer))).otherwise(after)
    fields = [F.when(ok, field(k, t)).alias(k) for k, t in FIELDS]
    return F.when(text.isNotNull(), F.struct(ok.alias("ok"), *fields, F.when(ok, body).alias("body")))


def missing_fields(front: Column) -> Column:
    """Names of required fields that are null or empty."""
    empty = [F.when(front[k].isNull() | (front[k].cast("string") == ""), F.lit(k)) for k in REQUIRED]
    return F.array_compact(F.array(*empty))


def lines(text: Column) -> Column:
    """Stripped lines that aren't empty."""
    return F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def summary_line(body: Column, name: Column) -> Column:
    """The first line after the first heading, or the directory's name."""
    rows = lines(body)
    first = F.array_position(F.transform(rows, lambda x: F.startswith(x, F.lit("#")).cast("int")), 1)
    after = F.get(rows, first.cast("int"))
    return F.when((first > 0) & after.isNotNull(), after).otherwise(F.concat(name, F.lit(" directory")))


def purpose_and_notes(body: Column, name: Column) -> Column:
    """struct<purpose, notes>: the first line that is no heading, and the bullets under Notes."""
    state = F.struct(F.lit(None).cast("string").alias("purpose"), F.array().cast("array<string>").alias("notes"), F.lit(False).alias("inside"))

    def step(s: Column, x: Column) -> Column:
        head = F.startswith(x, F.lit("## "))
        first = s["purpose"].isNull() & ~head
        note = F.trim(F.substring(x, 3, 1 << 30))
        take = s["inside"] & F.startswith(x, F.lit("- ")) & ~note.isin("", "None") & ~first & ~head
        now = F.struct(
            F.when(first, x).otherwise(s["purpose"]).alias("purpose"),
            F.when(take, F.concat(s["notes"], F.array(note))).otherwise(s["notes"]).alias("notes"),
            F.when(first, s["inside"]).when(head, x == "## Notes").otherwise(s["inside"]).alias("inside"),
        )
        return F.when(F.startswith(x, F.lit("# ")), s).otherwise(now)

    default = F.concat(name, F.lit(" directory."))
    return F.aggregate(lines(body), state, step, lambda s: F.struct(F.coalesce(s["purpose"], default).alias("purpose"), s["notes"].alias("notes")))


def render_body(path: Column, purpose: Column, files: Column, dirs: Column, notes: Column) -> Column:
    """files, dirs: array<struct<name, summary>> in order."""

    def section(title: str, rows: Column, slash: str) -> Column:
        bullets = F.transform(rows, lambda r: F.concat(F.lit("- **"), r["name"], F.lit(f"{slash}** — "), r["summary"]))
        return F.concat(F.lit(f"## {title}\n"), F.when(F.size(rows) > 0, F.array_join(bullets, "\n")).otherwise("- None"))

    extra = F.when(F.size(notes) > 0, F.concat(F.lit("\n\n## Notes\n"), F.array_join(F.transform(notes, lambda n: F.concat(F.lit("- "), n)), "\n"))).otherwise("")
    head = F.concat(F.lit("# "), path, F.lit("\n\n"), F.trim(purpose), F.lit("\n\n"))
    return F.concat(head, section("Files", files, ""), F.lit("\n\n"), section("Subdirectories", dirs, "/"), extra, F.lit("\n"))


def render(front: dict[str, Column], body: Column, footer: str = FOOTER) -> Column:
    """The whole file, its fields in their fixed order."""
    rows = [F.concat(F.lit(f"{k}: "), scalar(front[k]) if t == "string" else front[k].cast("string")) for k, t in FIELDS]
    return F.concat(F.lit("---\n"), F.array_join(F.array(*rows), "\n"), F.lit("\n---\n"), body, F.lit(footer))


def _parsed(body: Column, use: Callable[[Column], Column]) -> Column:
    """use(struct<heading, purpose, lines, skip, spans>): spans are the sections' titles, places and ends among the lines.

    Every line is visited a fixed number of times. A body that doesn't open with
    a heading has no sections; the first line after it that is no section's
    heading is the purpose, and no section's entry (skip is its place).
    """

    def found(rows: Column) -> Column:
        n = F.size(rows)
        opens = F.coalesce(F.startswith(F.get(rows, F.lit(0)), F.lit("# ")), F.lit(False))
        places = F.when(opens & (n > 1), F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        line = lambda i: F.get(rows, i)
        heads = F.filter(places, lambda i: F.startswith(line(i), F.lit("## ")))
        first = F.get(F.filter(places, lambda i: ~F.startswith(line(i), F.lit("## "))), F.lit(0))

        def spans(h: Column) -> Column:
            ends = F.concat(F.slice(h, 2, 1 << 30), F.array(n))
            return F.zip_with(h, ends, lambda a, b: F.struct(F.lower(F.trim(F.substring(line(a), 4, 1 << 30))).alias("title"), a.alias("at"), b.alias("end")))

        heading = F.when(opens, F.trim(F.substring(line(F.lit(0)), 3, 1 << 30)))
        cut = let(heads, lambda h: F.when(F.size(h) > 0, spans(h)).otherwise(F.array().cast("array<struct<title:string,at:int,end:int>>")))
        return F.struct(heading.alias("heading"), line(first).alias("purpose"), rows.alias("lines"), first.alias("skip"), cut.alias("spans"))

    return let(lines(body), lambda rows: let(found(rows), use))


def _rows(p: Column, title: str) -> Column:
    """The lines of all sections of that title, in order."""
    own = F.filter(p["spans"], lambda s: s["title"] == title)
    inside = F.flatten(F.transform(own, lambda s: F.when(s["end"] - s["at"] > 1, F.sequence(s["at"] + 1, s["end"] - 1)).otherwise(F.array().cast("array<int>"))))
    return F.transform(F.filter(inside, lambda i: ~i.eqNullSafe(p["skip"])), lambda i: F.get(p["lines"], i))


def _section_issues(title: str, parsed: Column, expected: Column, slash: bool) -> Column:
    label = lambda s: F.lit(f"{title} {s}")
    nothing = F.array().cast("array<string>")
    name = lambda x: F.trim(F.regexp_extract(x, _BULLET, 1))
    fine = lambda x: (name(x) != "") & (F.trim(F.regexp_extract(x, _BULLET, 2)) != "")
    ends = lambda n: F.endswith(n, F.lit("/"))
    odd = (lambda n: ~ends(n)) if slash else ends
    complaint = "entry is missing a trailing slash: " if slash else "entry should not end with '/': "

    def complaints(rows: Column) -> Column:
        per_row = F.transform(rows, lambda x: F.when(~fine(x), F.concat(label("section contains a malformed bullet: "), x)).when(odd(name(x)), F.concat(label(complaint), name(x))))

        def lists(seen: Column) -> Column:
            twice = F.array_distinct(F.filter(seen, lambda n, i: (i > 0) & n.eqNullSafe(F.get(seen, i - 1))))
            lacking, extra = F.array_sort(F.array_except(expected, seen)), F.array_sort(F.array_except(seen, expected))
            found = ((twice, "section contains duplicate entries: "), (lacking, "section is missing real entries: "), (extra, "section lists nonexistent entries: "))
            return F.array(*[F.when(F.size(x) > 0, F.concat(label(t), F.array_join(x, ", "))) for x, t in found])

        names = F.array_sort(F.transform(F.filter(rows, fine), lambda x: F.regexp_replace(name(x), "/+$", "")))
        illegal = F.when((F.size(rows) != 1) | (F.size(expected) > 0), F.array(label("section contains an illegal None row."))).otherwise(nothing)
        return F.when(F.array_contains(rows, "- None"), illegal).otherwise(F.array_compact(F.concat(per_row, let(names, lists))))

    absent = F.array(F.lit(f"Manifest body is missing the '## {title}' section."))
    return F.when(F.exists(parsed["spans"], lambda s: s["title"] == title.lower()), let(_rows(parsed, title.lower()), complaints)).otherwise(absent)


def validate(path: Column, body: Column, n_files: Column, n_dirs: Column, files: Column, dirs: Column) -> Column:
    """array<string>: every way in which a body differs from its directory, in a fixed order. Linear in the entries but for sorting them."""

    def issues(p: Column) -> Column:
        count = lambda label, n, names: F.when(n != F.size(names), F.format_string(f"Frontmatter {label}=%d does not match filesystem {label}=%d.", n, F.size(names)))
        head = F.array_compact(
            F.array(
                count("files", n_files, files),
                count("dirs", n_dirs, dirs),
                F.when(~p["heading"].eqNullSafe(path), F.concat(F.lit("Manifest heading should be '# "), path, F.lit("'."))),
                F.when(p["purpose"].isNull(), F.lit("Manifest body is missing the directory purpose sentence.")),
            )
        )
        bad = let(_rows(p, "notes"), lambda rows: F.array_contains(rows, "- None") & (F.size(rows) > 1))
        tail = F.when(bad, F.array(F.lit("Notes section contains an illegal None row."))).otherwise(F.array().cast("array<string>"))
        return F.concat(head, _section_issues("Files", p, files, False), _section_issues("Subdirectories", p, dirs, True), tail)

    return _parsed(body, issues)
