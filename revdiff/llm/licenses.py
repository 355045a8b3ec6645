"""Licence scans by sentence rules: normalised sentences become identifiers of known licence
sentences, and the sequence of identifiers is matched against ordered licence rules."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Short references to a licence, as the name after "licensed under".
NAMES = {
    "MIT": ["mit license", "mit", "mit/x11 license"],
    "Apache-2.0": ["apache license 2.0", "apache license 2.0 license", "apache 2.0 license", "apache-2.0", "apache 2.0"],
    "GPL-2.0": ["gnu general public license 2", "gnu gpl 2", "gpl 2", "gpl-2.0"],
    "GPL-3.0": ["gnu general public license 3", "gnu gpl 3", "gpl 3", "gpl-3.0"],
    "LGPL-2.1": ["gnu lesser general public license 2.1", "lgpl 2.1", "lgpl-2.1"],
    "LGPL-3.0": ["gnu lesser general public license 3", "lgpl 3", "lgpl-3.0"],
    "AGPL-3.0": ["gnu affero general public license 3", "agpl 3", "agpl-3.0"],
    "BSD-2-Clause": ["bsd 2-clause license", "2-clause bsd license", "simplified bsd license", "bsd-2-clause"],
    "BSD-3-Clause": ["bsd 3-clause license", "3-clause bsd license", "new bsd license", "bsd license", "bsd-3-clause"],
    "MPL-2.0": ["mozilla public license 2.0", "mpl 2.0", "mpl-2.0"],
    "EPL-2.0": ["eclipse public license 2.0", "epl 2.0", "epl-2.0"],
    "ISC": ["isc license", "isc"],
    "Unlicense": ["unlicense"],
    "CC0-1.0": ["cc0 1.0", "cc0", "creative commons zero 1.0", "cc0-1.0"],
    "CC-BY-4.0": ["cc by 4.0", "creative commons attribution 4.0 international license", "cc-by-4.0"],
    "CC-BY-SA-4.0": ["cc by-sa 4.0", "creative commons attribution-sharealike 4.0 international license", "cc-by-sa-4.0"],
    "CC-BY-NC-4.0": ["cc by-nc 4.0", "creative commons attribution-noncommercial 4.0 international license", "cc-by-nc-4.0"],
    "CC-BY-ND-4.0": ["cc by-nd 4.0", "creative commons attribution-noderivatives 4.0 international license", "cc-by-nd-4.0"],
    "CC-BY-NC-SA-4.0": ["cc by-nc-sa 4.0", "creative commons attribution-noncommercial-sharealike 4.0 international license", "cc-by-nc-sa-4.0"],
}
#: The current SPDX identifiers of the GNU licences, each a licence of its own.
SPDX_NAMES = {f"{x}-only": [f"{x}-only".lower()] for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")} | {
    f"{x}-or-later": [f"{x}-or-later".lower(), f"{x}+".lower()] for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
}
#: Sentences of licence texts and notices, by identifier.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    "the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission.",
    "apache-use": "You may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl2-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "all-rights": "All rights reserved.",
}
#: Ordered rules: a licence and the sentences that show it, in sequence; earlier rules take their sentences first.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-grant"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["ref-Apache-2.0", "apache-use", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["ref-Apache-2.0", "apache-use", "apache-copy"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-hope", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-hope", "gpl-see"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("MPL-2.0", ["mpl-subject"]),
    ("Unlicense", ["unlicense-free"]),
    *((name, [f"ref-{name}"]) for name in NAMES),
    ("Proprietary", ["all-rights"]),
]
#: Texts without one of these are not cut into sentences: each known sentence has one. Normalising makes words of a
#: text only where "under" stands ("licensed under"), and never joins two, so the text has it as well.
HINT = "licen[cs]e|permission|redistribut|copyright|spdx|software|warrant|event|rights|source|neither|under"
# A sentence ends at punctuation before white space, at an empty line, and at a line end unless the next line goes on in lower case
# or both lines are in capitals, or the line ends in a word that ends no sentence.
# Comment marks at the start of lines go first; \x1e marks the ends.
CUTS = [
    (r"\r\n?", "\n"), (r"([sS][pP][dD][xX]-[A-Za-z]+-[A-Za-z]+):[ \t]*([A-Za-z0-9.+-]+)", "\\1 \\2\x1e"), (r"(^|\n)[ \t]*(?://+|/\*+|\*+/|\*+|#+|--|<!--)[ \t]*", r"\1"), (r"\n[ \t]*\n\s*", "\x1e"), (r"\s+(https?://)", "\x1e\\1"),
    (r"(?i)\b(the|an?|of|or|and|to|in|this|that|by|for|with)[ \t]*\n[ \t]*", r"\1 "),
    (r"([A-Z,;])[ \t]*\n[ \t]*([A-Z][A-Z])", r"\1 \2"), (r"(;)[ \t]*\n", "\\1\x1e"), (r"([.!?:])\s+", "\\1\x1e"), (r"\n([ \t]*[^a-z(\"\s])", "\x1e\\1"),
]
# Every identifier of an SPDX expression becomes a sentence. In Spark \\G goes on where the one before ended; DuckDB has no \\G,
# so there \x1d marks that place, for up to ``CHAIN`` more identifiers.
CHAIN = 16
_SPDX = "[sS][pP][dD][xX]-[lL][iI][cC][eE][nN][sS][eE]-[iI][dD][eE][nN][tT][iI][fF][iI][eE][rR]:[ \\t(]*"
_AFTER = "\\x1d(?:AND|OR|WITH)[ \\t(]+"
DUCK_EXPRESSION = [
    (before + "([A-Za-z0-9.+-]+)" + end, "SPDX-License-Identifier \\1\x1e" + mark)
    for before in [_SPDX, *[_AFTER] * CHAIN] for end, mark in (("[ \\t)]+", "\x1d"), ("([^ \\t)A-Za-z0-9.+-]|$)", "\\2"))
] + [("\\x1d", "")]
EXPRESSION = (
    r"(?:[sS][pP][dD][xX]-[lL][iI][cC][eE][nN][sS][eE]-[iI][dD][eE][nN][tT][iI][fF][iI][eE][rR]:|\G(?<=[ \t)])(?:AND|OR|WITH)(?=[ \t(]))[ \t(]*([A-Za-z0-9.+-]+)[ \t)]*",
    "SPDX-License-Identifier \\1\x1e",
)
# Of a lower-case sentence: keep letters, digits and marks inside names; drop articles and "version"; one word for each way of licensing.
NORMAL = [
    (r"[^a-z0-9.+/-]+", " "), (r"[.]+( |$)", r"\1"), (r"(^| )[.+/-]+( |$)", " "), (r"\blicence", "license"), (r"\b(?:the|an?|version) ", ""),
    (r"\bv\.? ?([0-9])", r"\1"), (r"^ ?(?:[0-9]+|[ivx]+)\.? (redistribution|neither)", r"\1"),
    (r"^ ?(?:(?:this|these|all) (?:work|file|software|program|document|code|project|page|text|article|content|library|package)s? (?:is|are) )?"
     r"(?:made )?(?:licensed|released|distributed|available|published|provided|shared) under (?:terms (?:and conditions )?of )?", "licensed under "),
    (r" +", " "), (r"^ | $", ""),
]


def normal(sentence: str) -> str:
    """The same normalisation in Python, for the tables above."""
    import re

    out = sentence.lower()
    for pattern, new in NORMAL:
        out = re.sub(pattern, new, out)
    return out


def known_sentences(names: dict[str, list[str]] = NAMES) -> dict[str, str]:
    """Identifier of every known normalised sentence."""
    import re

    out = {}
    for key, text in SENTENCES.items():
        for pattern, new in CUTS:
            text = re.sub(pattern, new, text)
        parts = [normal(x) for x in text.split("\x1e") if normal(x)]
        out[max(parts, key=len)] = key  # one that has ends inside is known by its longest part
    for name, forms in names.items():
        for form in forms:
            out[normal(f"licensed under {form}")] = f"ref-{name}"
            out[normal(f"SPDX-License-Identifier: {form}")] = f"ref-{name}"
    return out


def _replaced(value: str, steps: list[tuple[str, str]], duck: bool) -> str:
    for pattern, new in steps:
        if duck:
            value = f"regexp_replace({value}, '{pattern}', '{new}', 'g')"
        else:
            value = f"regexp_replace({value}, r'{pattern}', r'{new.replace(chr(92), '$')}')"
    return value


def _steps(duck: bool, text_col: str) -> tuple[str, str, dict[str, str]]:
    """SQL for Spark or DuckDB: the marks of a text's known sentences (``ids``), the marks joined
    and rewritten by the rules (``m``), and the results from both."""
    names, cuts = NAMES | SPDX_NAMES, [*(DUCK_EXPRESSION if duck else [EXPRESSION]), *CUTS]
    rules = [*RULES, *((name, [f"ref-{name}"]) for name in SPDX_NAMES)]
    sentence, cut = _replaced("lower(s)", NORMAL, duck), _replaced(f"coalesce({text_col}, '')", cuts, duck)
    pairs = known_sentences(names).items()
    if duck:
        hint, split = f"regexp_matches(lower({text_col}), '{HINT}')", f"string_split({cut}, chr(30))"
        lookup = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs) + "}[s]"
        test, size, none, join = "regexp_matches(s, '{}')", "len", "[]", "array_to_string({}, '')"
        each, keep = "list_transform({}, lambda s: {})", "list_filter({}, lambda s: {})"
        found = "regexp_extract_all(m, '[{]([^}]+)[}]', 1)"
        once = f"""list_reduce(list_prepend('', {found}),
            lambda a, x: CASE WHEN contains(',' || a || ',', ',' || x || ',') THEN a WHEN a = '' THEN x ELSE a || ',' || x END)"""
    else:
        hint, split = f"lower({text_col}) RLIKE r'{HINT}'", f"split({cut}, '\x1e', -1)"
        lookup = "try_element_at(map(" + ", ".join(f"'{k}', '{v}'" for k, v in pairs) + "), s)"
        test, size, none, join = "s RLIKE '{}'", "size", "array()", "array_join({}, '')"
        each, keep = "transform({}, s -> {})", "filter({}, s -> {})"
        once = "array_join(array_distinct(regexp_extract_all(m, '[{]([^}]+)[}]', 1)), ',')"
    copyright_, odd = test.format("^(copyright|c [0-9]+) "), test.format("license")
    mark = f"coalesce('|' || {lookup} || '|', CASE WHEN {copyright_} THEN '' WHEN {odd} THEN '|unknown|' ELSE '' END)"
    marks = keep.format(each.format(each.format(split, sentence), mark), "s <> ''")
    ids = f"CASE WHEN {hint} THEN {marks} ELSE {none} END"
    matched = join.format("ids")
    for name, sequence in rules:
        matched = f"replace({matched}, '{''.join(f'|{x}|' for x in sequence)}', '{{{name}}}')"
    seen, unknown = keep.format("ids", "s <> '|unknown|'"), keep.format("ids", "s = '|unknown|'")
    return ids, matched, {
        "n_sentences": f"CAST({size}({seen}) AS BIGINT)", "sentence_ids": f"trim(replace(replace({join.format(seen)}, '||', ' '), '|', ''))",
        "licenses": once, "n_unknown": f"CAST({size}({unknown}) AS BIGINT)",
    }


def scan_sql(table: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """The scan in DuckDB SQL, for SPDX expressions of up to ``CHAIN`` + 1 identifiers."""
    ids, matched, results = _steps(True, text_col)
    listed = ", ".join(f"{v} {k}" for k, v in results.items())
    return f"SELECT {id_col}, {listed} FROM (SELECT *, {matched} m FROM (SELECT {id_col}, {ids} ids FROM {table}) a) b"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_sentences, sentence_ids, licenses, n_unknown`` of every row.

    ``sentence_ids``: known licence sentences in order; ``licenses``: what the ordered rules
    recognise in them, in order, each once; ``n_unknown``: other sentences that speak of a license.
    Each identifier of an SPDX expression (AND, OR, WITH, brackets; on one line) is a sentence.
    A null or empty text has none. Repeated rows, null ids: row by row. An empty table gives no
    rows. Other columns are not read. One scan, no shuffle, no Python.
    """
    ids, matched, results = _steps(False, "_text")
    rows = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("_text")).selectExpr(f"`{id_col}`", f"{ids} ids").selectExpr("*", f"{matched} m")
    return rows.selectExpr(f"`{id_col}`", *(f"{v} {k}" for k, v in results.items()))
