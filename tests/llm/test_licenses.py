"""Licence scans: spelling, punctuation and copyright lines don't matter, anything else does."""

import pkgutil
import re
import textwrap

from vigil.llm import licenses

def states_copyright(line):
    """A line with nothing but a copyright: its word or sign, then a year, sign or placeholder, or a year at the end."""
    said = re.sub(r"^[^0-9a-z]*", "", line)
    raw = line[:len(line) - len(said)]
    for start in ("copyright", "c)"):
        if said.startswith(start) and (start == "copyright" or raw.endswith("(")):
            rest = said[len(start):]
            lead = re.match(r"[^0-9a-z]*", rest)[0]
            after = rest[len(lead):]
            if re.match(r"[0-9]{4}", after) or (after.startswith("c)")) or "©" in lead:
                return True
            if lead[-1:] in list("<[{") and after.startswith(("year", "yyyy", "name", "copyright", "owner")):
                return True
            if start == "copyright" and re.search(r"[^0-9a-z][0-9]{4}[^0-9a-z]*$", rest):
                return True
    if "©" in raw and (re.match(r"[0-9]{4}|c\)", said) or raw.rindex("©") != raw.index("©") or
                       (raw[-1:] in list("<[{") and said.startswith(("year", "yyyy", "name", "copyright", "owner")))):
        return True
    return said.startswith("all rights reserved") and not re.search("[0-9a-z]", said[len("all rights reserved"):])


def canonical(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    t = "\n".join(" " if states_copyright(x) else x for x in t.split("\n"))
    t = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", t).strip(" ")
    for a, b in licenses.SPELLINGS:
        t = t.replace(a, b)
    return t


def test_scan(spark):
    mit = licenses.KNOWN[0][1]
    rows = [(1, mit), (2, "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + mit.upper().replace(",", " ;")), (3, mit + " But not on Sundays."),
            (4, "Some text.\n released under the  MIT-Licence!\nmore\nReleased under the MIT License."), (5, None), (6, ""), (1, mit), (None, "x" * 200000),
            (7, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (8, "Released under the MIT License, perhaps.")]
    df = spark.createDataFrame([(k, t, 9) for k, t in rows], "doc_id bigint, text string, license_id int")
    got = sorted(((r["doc_id"] or 0, r["license_id"] or "", r["notices"], r["n_notices"]) for r in licenses.scan(df).collect()))
    known = {canonical(t): i for i, t in reversed(licenses.KNOWN)}
    want = []
    for k, t in rows:
        own = [known[canonical(x)] for x in (t or "").split("\n") if canonical(x) in known]
        want.append((k or 0, known.get(canonical(t), ""), ",".join(sorted(set(own))), len(own)))
    assert got == sorted(want)
    assert want[1][1] == "MIT" and want[2][1] == "" and want[3][3] == 2
    assert licenses.scan(df.limit(0)).count() == 0
    assert licenses.scan(df, [("own", "x" * 200000)]).where("license_id = 'own'").count() == 1


def test_copyright_lines(spark):
    """Statements go, sentences stay; Java, DuckDB and plain Python agree."""
    import duckdb
    lines = ["Copyright (c) 2020 A. Person", "copyright 2020", " * Copyright © Some One", "© 2019-2020 X", "(C) 1995 Some One", "Copyright <year> <holder>",
             "Copyright [yyyy] [name of copyright owner]", "Copyright The Foo Authors, 2019.", "All rights reserved.", "-- all rights reserved --",
             "copyright notice and this permission notice appear in all copies.", "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM", "copyright law of 1976 protects works",
             "(c) You must retain, in the Source form", "all rights reserved to us", "copyright", "(c)", "©", "Copyright20201", "copyright\r", "x copyright (c) 2020",
             "copyright \u2028 2020 x", "\u2028copyright 2020", "\u0085(c) 2020", "é copyright 2020", "copyright é 2020", "copyright 12345", "© (c) x", "©© x"]
    text = [f"a\n{x}\nb" for x in lines]
    want = [canonical(t) for t in text]
    df = spark.createDataFrame(list(enumerate(text)), "n int, text string")
    assert [r["c"] for r in df.select("n", licenses.canonical(df["text"]).alias("c")).orderBy("n").collect()] == want
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in text]
    got = [duckdb.execute("SELECT regexp_replace(?, ?, ' ', 'g')", [t, f"(?m){licenses.COPYRIGHT_LINE}"]).fetchone()[0] for t in low]
    assert got == ["\n".join(" " if states_copyright(x) else x for x in t.split("\n")) for t in low]
    assert want[10].startswith("a copyright notice") and want[0] == "a b"


def test_lines_looked_up(spark):
    """The lines that are looked up hold all that the whole table of lines would find, whatever the spelling of their first word."""
    known = [("A", "Licensed by the board"), ("B", "sublicense-license it"), ("C", "percent of all"), ("D", "Été sans fin"), ("E", "noninfringement")]
    lines = ["licenced BY the board", "  (Licensed by the board)", "sub licence licence it", "sublicense licence it", "per cent of all", "été sans fin", "Été sans fin!",
             "non infringement", "Non-Infringement", "we are licensed by the board", "", "percent", "sub license\tlicense it\r"]
    df = spark.createDataFrame([(1, "\n".join(lines), 5), (2, "\n\n" + lines[0], 6)], "doc_id int, text string, __key int")
    got = {r["doc_id"]: (r["notices"], r["n_notices"], r["__key"]) for r in licenses.scan(df, known).collect()}
    plain = {canonical(t): i for i, t in known}
    own = [plain[canonical(x)] for x in lines if canonical(x) in plain]
    assert got == {1: (",".join(sorted(set(own))), len(own), 5), 2: ("A", 1, 6)} and len(own) == 9
    every = licenses.scan(df, [*known, ("none", "--")]).where("doc_id = 2").first()
    assert (every["notices"], every["n_notices"]) == ("A,none", 3)


def test_any_width(spark):
    """All texts are found wrapped at each width from 36 to 130, with indented lines or not."""
    texts = dict(reversed(licenses.KNOWN[:6])) | {"Zlib": licenses._ZLIB, "Unlicense": licenses._UNLICENSE}
    rows = [(name, width, "\n\n".join(textwrap.fill(x, width, subsequent_indent=indent) for x in text.split("\n\n")))
            for name, text in texts.items() for width in range(36, 131) for indent in ("", "   ")]
    df = spark.createDataFrame(rows, "want string, width int, text string")
    assert licenses.scan(df).where("license_id is null or license_id != want").select("want", "width").collect() == []


def test_published_wrappings(spark):
    """Every licence as it is published: with its title, a copyright statement, and lines that go on with ``copyright``."""
    full = dict(reversed(licenses.KNOWN[:6]))
    isc = full["ISC"].replace("the above copyright", "the above\ncopyright")
    rows = [("ISC", "ISC License\n\nCopyright (c) 2021, A. Person\n\n" + isc)]
    for name, title in {"MIT": "The MIT License (MIT)", "ISC": "ISC License", "0BSD": "BSD Zero Clause License", "BSD-2-Clause": "BSD 2-Clause License",
                        "BSD-3-Clause": "BSD 3-Clause License"}.items():
        for width in (65, 70, 72, 76, 78, 79, 80):
            body = "\n\n".join(textwrap.fill(x, width, subsequent_indent="   " if x[:1].isdigit() else "") for x in full[name].split("\n\n"))
            rows += [(name, f"{title}\n\nCopyright (c) 2021, A. Person\n\n{body}\n"), (name, body)]
    rows += [(name, pkgutil.get_data("vigil.llm", f"license_texts/{file}.txt").decode()) for name, file in getattr(licenses, "FILES", {}).items()]
    rows += [("Unlicense", licenses._UNLICENSE), ("Zlib", "zlib License\n\n(C) 1995 Some One\n\n" + licenses._ZLIB)]
    df = spark.createDataFrame(rows, "want string, text string")
    assert [(r["want"], r["text"][:200]) for r in licenses.scan(df).where("license_id is null or license_id != want").collect()] == []
