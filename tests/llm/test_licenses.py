import re

from revdiff.llm import licenses

from . import cases


def wrapped(text, mark="", width=60):
    lines, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            lines.append(line)
            line = ""
        line = f"{line} {word}".strip()
    return "\n".join(f"{mark}{x}".rstrip() for x in [*lines, line])


def test_every_known_sentence_has_a_hint():
    assert all(re.search(licenses.HINT, s) for s in licenses.known_sentences(licenses.NAMES | licenses.SPDX_NAMES))


def test_ways_of_licensing_are_no_matter(spark):
    texts = ["This text is released under CC BY 4.0.", "Published\nunder the GPL 3.", "Released under MIT.", "provided under  the CC0."]
    got = licenses.scan(cases.documents(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == ["CC-BY-4.0", "GPL-3.0", "MIT", "CC0-1.0"]


def test_sql_reads_the_same(spark):
    import duckdb

    texts = [
        "// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;", "# spdx-license-identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND (LGPL-2.1-only OR BSD-3-Clause)",
        "SPDX-License-Identifier: ISC\nOR this\nOR MIT", "OR MIT AND then some. SPDX-License-Identifier:AGPL-3.0-only", "SPDX-License-Identifier: ((MIT AND Foo-1.0)OR(MPL-2.0))",
        "Provided under CC0. SPDX-License-Identifier: " + " OR ".join(["MIT", "ISC", "MPL-2.0"] * 5), "", None, licenses.SENTENCES["mit-grant"],
    ]
    rows = list(enumerate(texts))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(licenses.scan_sql("documents") + " ORDER BY doc_id")
    names = [d[0] for d in want.description]
    got = licenses.scan(cases.documents(spark, rows)).select(*names).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want.fetchall()


def test_notices(spark):
    s = licenses.SENTENCES
    mit = "\n#\n".join(wrapped(s[x], "# ") for x in ("mit-grant", "mit-notice")) + "\n#\n" + wrapped(s["mit-as-is"] + " " + s["mit-liability"], "# ")
    texts = {
        1: ("Copyright (c) 2020 Someone\n\n" + mit + "\nprint(1)", "MIT"),
        2: ("Words here. Licensed under CC BY-NC 4.0. More words. Released under the MIT Licence.", "CC-BY-NC-4.0,MIT"),
        3: ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        4: ("// SPDX-License-Identifier: BSD-3-Clause\nint x;", "BSD-3-Clause"),
        5: (" * ".join(["/*\n", *(s[x] + "\n" for x in ("bsd-grant", "bsd-source", "bsd-binary"))]), "BSD-2-Clause"),
        6: ("* ".join(["/*\n", *(s[x] + "\n" for x in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"))]), "BSD-3-Clause"),
        7: ("The driving license was lost.", ""),
        8: (wrapped("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                    + s["apache-copy"] + " http://www.apache.org/licenses/LICENSE-2.0", ""), None),
    }
    got = {r.doc_id: r for r in licenses.scan(cases.documents(spark, [(i, t) for i, (t, _) in texts.items()])).collect()}
    for i, (_, want) in texts.items():
        if want is not None:
            assert got[i].licenses == want, (i, got[i])
    assert got[7].n_unknown == 1 and got[2].sentence_ids == "ref-CC-BY-NC-4.0 ref-MIT"


def test_odd_rows(spark):
    docs = cases.documents(spark, cases.ODD)
    got = licenses.scan(docs).collect()
    assert len(got) == len(cases.ODD) and all((r.n_sentences, r.licenses, r.n_unknown) == (0, "", 0) for r in got)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_every_identifier_of_an_spdx_expression(spark):
    texts = {
        1: ("// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;", "MIT,Apache-2.0", 0),
        2: ("# spdx-license-identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND (LGPL-2.1-only OR BSD-3-Clause)", "GPL-2.0-or-later,LGPL-2.1-only,BSD-3-Clause", 1),
        3: ("/* SPDX-License-Identifier: GPL-2.0+ */\n", "GPL-2.0-or-later", 0),
        4: ("SPDX-License-Identifier: ISC\nOR this\nOR MIT", "ISC", 0),
        5: ("OR MIT AND then some. SPDX-License-Identifier:AGPL-3.0-only", "AGPL-3.0-only", 0),
        6: ("SPDX-License-Identifier: ((MIT AND Foo-1.0)OR(MPL-2.0))", "MIT,MPL-2.0", 1),
    }
    got = {r.doc_id: (r.licenses, r.n_unknown) for r in licenses.scan(cases.documents(spark, [(i, t) for i, (t, *_) in texts.items()])).collect()}
    assert got == {i: (a, n) for i, (_, a, n) in texts.items()}
