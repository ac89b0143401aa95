"""Licence scans by sentence rules.

A text is normalised as a whole (lower case, anything but letters, digits and
+ becomes one blank, so that wrapped lines and comment marks don't matter), and
known licence sentences are looked for in it from left to right, the longest
first, also inside of longer sentences.
The identifiers found, in their order, form a sequence; the rules, longest
and most specific first, replace every run of identifiers that they describe
by their licence, so that a shorter rule never claims a part of a longer one.
All of it is built-in string and array functions, inside the JVM.

Result: (doc_id, n_sentences, sequence, licenses): how many known sentences,
the identifiers left and licences found, and the licences alone, comma-joined
in order of appearance.

Defined results: null, empty and other texts without a known sentence have 0,
'' and ''; texts are scanned whole; repeated rows and rows with a null doc_id
give a row each; only doc_id and text are read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartwood.llm.common import id_text

_SOFTWARE_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
#: identifier: normalised sentences. Public licence texts and notices in common use.
SENTENCES: dict[str, list[str]] = {
    "apache2-notice": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"],
    "apache2-use": ["you may not use this file except in compliance with the license", "you may not use this file except in compliance with the license you may obtain a copy of the license at"],
    "apache2-as-is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache2-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit-notice": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license", "mit license", "the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-condition": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-as-is": [_SOFTWARE_AS_IS],
    "mit-liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "gpl3-notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3", "gnu general public license version 3"],
    "gpl2-notice": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2", "gnu general public license version 2"],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-see": ["see the gnu general public license for more details"],
    "agpl3-notice": ["licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3"],
    "lgpl3-notice": ["licensed under the gnu lesser general public license version 3", "this work is licensed under the gnu lesser general public license version 3"],
    "bsd-redistribute": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd3-notice": ["licensed under the bsd 3 clause license", "released under the bsd 3 clause license", "bsd 3 clause license"],
    "bsd2-notice": ["licensed under the bsd 2 clause license", "released under the bsd 2 clause license", "bsd 2 clause license"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl2-notice": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "cc0": ["released under cc0 1 0 license", "licensed under cc0 1 0", "to the extent possible under law the author has waived all copyright and related rights to this work"],
    "rights-reserved": ["all rights reserved"],
    **{f"cc-{k.replace(' ', '-')}-{v}": [f"licensed under cc {k} {v} 0", f"this work is licensed under cc {k} {v} 0"] for k in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd") for v in (3, 4)},
}
#: (licence, identifiers), in order: an earlier rule takes its sentences from the later ones.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("apache2-notice", "apache2-use", "apache2-as-is", "apache2-see")),
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("MIT", ("mit-notice", "mit-grant", "mit-condition", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-condition", "mit-as-is", "mit-liability")),
    ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("Apache-2.0", ("apache2-notice",)),
    ("MIT", ("mit-notice",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-2.0", ("gpl2-notice",)),
    ("AGPL-3.0", ("agpl3-notice",)),
    ("LGPL-3.0", ("lgpl3-notice",)),
    ("BSD-3-Clause", ("bsd3-notice",)),
    ("BSD-2-Clause", ("bsd2-notice",)),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0",)),
    *[(f"CC-{k.upper()}-{v}.0", (f"cc-{k}-{v}",)) for k in ("by-nc-sa", "by-nc-nd", "by-sa", "by-nc", "by-nd", "by") for v in (3, 4)],
    ("All-Rights-Reserved", ("rights-reserved",)),
]
#: Every known sentence holds one of these, so a text without any needs no splitting.
KEYS = ("licens", "software", "redistribution", "rights", "warrant")


def _pattern() -> str:
    """Any known sentence between blanks, the longest first; alternatives share their first word."""
    by: dict[str, list[str]] = {}
    for v in SENTENCES.values():
        for x in v:
            first, _, rest = x.partition(" ")
            by.setdefault(first, []).append(rest)
    known = "|".join(f"{w} (?:{'|'.join(re.escape(x).replace(chr(92) + ' ', ' ') for x in sorted(set(rest), key=lambda x: (-len(x), x)))})" for w, rest in sorted(by.items()))
    return f"(?<= )({known})(?= )"


def scan(docs: DataFrame) -> DataFrame:
    rows = id_text(docs)
    low = F.lower(F.coalesce("text", F.lit("")))
    words = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9+]+", " "), F.lit(" "))
    known = F.create_map(*[F.lit(x) for k, v in SENTENCES.items() for s in v for x in (s, k)])
    ids = F.transform(F.regexp_extract_all(words, F.lit(_pattern()), F.lit(1)), lambda s: F.element_at(known, s))
    maybe = F.lit(False)
    for k in KEYS:
        maybe = maybe | F.contains(low, F.lit(k))
    found = rows.select("doc_id", F.when(maybe, ids).otherwise(F.array().cast("array<string>")).alias("ids"))
    sequence = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    for k, (_, rule) in enumerate(RULES, 1):
        sequence = F.replace(sequence, F.lit("".join(f"<{i}>" for i in rule)), F.lit(f"#{k};"))
    names = F.array(*[F.lit(n) for n, _ in RULES])
    out = found.select("doc_id", F.size("ids").alias("n_sentences"), sequence.alias("s"))
    numbers = F.regexp_extract_all("s", F.lit("#([0-9]+);"), F.lit(1))
    licenses = F.array_join(F.transform(numbers, lambda n: F.element_at(names, n.cast("int"))), ",")
    return out.select("doc_id", "n_sentences", F.regexp_replace("s", "#[0-9]+;", "<=>").alias("sequence"), licenses.alias("licenses"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    known = ", ".join(f"('{s}', '{k}')" for k, v in SENTENCES.items() for s in v)
    sequence = "seq"
    for k, (_, rule) in enumerate(RULES, 1):
        sequence = f"replace({sequence}, '{''.join(f'<{i}>' for i in rule)}', '#{k};')"
    names = ", ".join(f"'{n}'" for n, _ in RULES)
    return f"""
WITH known(sentence, id) AS (VALUES {known}), lines AS (
  SELECT doc_id, row_id, unnest(parts) AS part, unnest(range(len(parts))) AS place FROM (
    SELECT doc_id, row_number() OVER () AS row_id,
           string_split(regexp_replace(lower(coalesce(text, '')), '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS parts
    FROM documents)
), ids AS (
  SELECT doc_id, row_id, count(id)::int AS n, coalesce(string_agg('<' || id || '>', '' ORDER BY place) FILTER (id IS NOT NULL), '') AS seq
  FROM lines LEFT JOIN known ON sentence = trim(regexp_replace(part, '[^a-z0-9+]+', ' ', 'g')) GROUP BY doc_id, row_id
), ruled AS (SELECT doc_id, n, {sequence} AS s FROM ids)
SELECT doc_id, n AS n_sentences, regexp_replace(s, '#[0-9]+;', '<=>', 'g') AS sequence,
       array_to_string(list_transform(regexp_extract_all(s, '#([0-9]+);', 1), lambda x: ([{names}])[x::int]), ',') AS licenses
FROM ruled
"""


SQL = _sql()
