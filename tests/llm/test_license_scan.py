import textwrap

import pytest
import zstandard
from pyspark.sql import functions as F

from gradeflow.llm.license_scan import NOTICES, TEMPLATES, Scanner, names, scan


@pytest.fixture(scope="module")
def scanner():
    return Scanner()


@pytest.mark.parametrize("name, text", TEMPLATES)
def test_every_template_finds_itself(scanner, name, text):
    t = f"Prose before.\n{text}\nProse after the licence."
    assert [(f.license, t[f.start : f.end], f.agreement, f.missing, f.added) for f in scanner.scan(t)] == [(name, text, 1.0, "", "")]


def test_variants_and_neighbours(scanner):
    one = lambda t: [f.license for f in scanner.scan(t)]
    assert one("  * licensed under the APACHE license version 2.0") == ["Apache-2.0"]
    assert one("This program is licensed under the GNU General Public License version 3, see below") == ["GPL-3.0"]
    assert one("// SPDX-License-Identifier: BSD-3-Clause") == ["BSD-3-Clause"]
    assert one("Licensed under the Apache License, Version 1.1.") == []
    assert one("Licensed under CC BY-NC 3.0.") == [] and one("the driver's licence was public domain folklore") == []
    (f,) = scanner.scan("This work is also licensed under the GNU General Public License, version 3.")
    assert (f.license, f.missing, f.added) == ("GPL-3.0", "", "also") and f.saving > 0.2
    long = "word " * 200 + "x. Released under the MIT License. Then " + "word " * 200
    (f,) = scanner.scan(long)
    assert long[f.start : f.end] == "Released under the MIT License."


def test_rows(docs_of):
    lines = ["Licensed under CC BY-NC 4.0.", "Released under the MIT License."]
    texts = [None, "", "clean", "\n".join([*lines, lines[0]]), "é😀\n" + lines[1], "x" * 200_000 + "\n" + lines[0], lines[0], lines[0]]
    got = scan(docs_of(texts, extra=True)).select("doc_id", F.size("found").alias("n"), names(F.col("found")).alias("names"), "found").collect()
    assert {r.doc_id: (r.n, r.names) for r in got} == {0: (0, ""), 1: (0, ""), 2: (0, ""), 3: (3, "CC-BY-NC-4.0,MIT"), 4: (1, "MIT"), 5: (1, "CC-BY-NC-4.0"), 6: (1, "CC-BY-NC-4.0"), 7: (1, "CC-BY-NC-4.0")}
    assert all(texts[r.doc_id][f.start : f.end] in lines for r in got for f in r.found)
    assert scan(docs_of([])).collect() == []


def test_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    notices = {t: n for n, t in TEMPLATES}
    want = {r.doc_id: sorted(notices[x] for x in r.text.split("\n") if x in notices) for r in docs.collect()}
    assert sum(map(len, want.values())) > 10
    assert {r.doc_id: sorted(f.license for f in r.found) for r in scan(docs).collect()} == want


def test_wrapped_notices(scanner):
    mit = "/* Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal\n * in the Software without restriction. */"
    text = f"Some prose.\n\n{mit}\n\nint main;"
    (f,) = scanner.scan(text)
    assert f.license == "MIT" and text[f.start : f.end].startswith("Permission is") and text[f.start : f.end].endswith("without restriction.")
    mpl = "prose of one line\n# This Source Code Form is subject to the terms of the Mozilla\n# Public License, version 2.0.\nprose of another"
    assert [f.license for f in scanner.scan(mpl)] == ["MPL-2.0"]


def test_several_in_a_line(scanner):
    text = "Released under the MIT License. Licensed under CC BY 4.0."
    assert [(f.license, text[f.start : f.end]) for f in scanner.scan(text)] == [("MIT", "Released under the MIT License."), ("CC-BY-4.0", "Licensed under CC BY 4.0.")]
    assert [f.license for f in scanner.scan("// SPDX-License-Identifier: MIT OR Apache-2.0")] == ["MIT", "Apache-2.0"]
    assert [f.license for f in scanner.scan("SPDX-License-Identifier: (GPL-2.0 WITH Classpath-exception-2.0) AND ISC SPDX-License-Identifier: MIT")] == ["GPL-2.0", "ISC", "MIT"]


@pytest.mark.parametrize("mark", ["", "# ", " * "])
@pytest.mark.parametrize("name, text, telling", NOTICES)
def test_whole_notices_wrapped_behind_comment_marks(scanner, name, text, telling, mark):
    half = text.find(". ", len(text) // 2) + 1
    body = [mark + x for part in (text[:half], text[half:]) for x in [*textwrap.wrap(part, 72), ""]]
    t = "\n".join(["Some prose before the notice.", "Copyright (c) 2020 Someone", "", *body, "int main(void);"])
    found = scanner.scan(t)
    assert name in [f.license for f in found]
    (f,) = [f for f in found if f.license == name]
    # where a line is a short notice by itself, that is what is found
    assert f.agreement > 0.95 and t[f.start : f.end].lstrip("#* ").split()[0] == text.split()[0]


def test_notice_with_other_words(scanner):
    text = next(t for n, t, _ in NOTICES if n == "MIT").replace("free of charge", "without any charge")
    (f,) = scanner.scan(text)
    assert (f.license, f.added, f.missing) == ("MIT", "without any", "free of")


def test_every_pair_of_short_notices_in_a_block(scanner):
    for n, t in TEMPLATES:
        for m, u in TEMPLATES:
            if n != m:
                found = [f.license for f in scanner.scan(f"{t} {u}")]
                assert n in found and m in found, (n, m, found)


@pytest.mark.parametrize("n", [1, 50, 1500, 20_000])
def test_many_notices_in_a_line(scanner, n):
    line = "Released under the MIT License " * n
    assert [f.license for f in scanner.scan(line)] == ["MIT"] * n
    mixed = "Released under the MIT License, or Licensed under the Apache License, Version 2.0; " * (n // 4)
    assert [f.license for f in scanner.scan(mixed)] == ["MIT", "Apache-2.0"] * (n // 4)


def test_notices_far_apart_in_a_line(scanner):
    filler = " filler words of no use" * 400 + " "
    line = filler.join(["", *(t for _, t in TEMPLATES), ""])
    found = scanner.scan(line)
    assert [f.license for f in found] == [n for n, _ in TEMPLATES]
    assert all(filler.strip() not in line[f.start : f.end] for f in found[1:-1])


def test_tags_and_notices_of_one_line(scanner):
    one = lambda t: [f.license for f in scanner.scan(t)]
    assert one("SPDX-License-Identifier: MIT. Parts are licensed under the Apache License, Version 2.0.") == ["MIT", "Apache-2.0"]
    assert one("Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH x-1.0).") == ["Apache-2.0", "MIT", "GPL-2.0-only"]


def test_other_words_that_are_not_decisive(scanner):
    one = lambda t: [(f.license, f.missing, f.added) for f in scanner.scan(t)]
    mit = next(t for n, t, _ in NOTICES if n == "MIT")
    assert one(mit.replace("free of charge", "free of cost")) == [("MIT", "charge", "cost")]
    assert one("released under the M.I.T. License") == [("MIT", "", "")]
    for other in ("Licensed under the Foo License, Version 2.0.", "This Source Code Form is subject to the terms of the Foo Public License, version 2.0.", "Licensed under CC BY-NC.", "Released under the X License"):
        assert one(other) == [], other


def test_ranking_against_every_block_and_template(spark):
    """Of the templates whose words stand in a line one after another, that found saves the most bytes."""
    import re

    word = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
    plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += [f"So: {t} And more." for _, t in TEMPLATES] + [f"So: {t} And more." for _, t, _ in NOTICES]
    held = [(n, " " + " ".join(word.findall(t.lower())) + " ", zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)) for n, t, *_ in TEMPLATES + NOTICES]
    scanner, met = Scanner(), 0
    for line in {x for t in texts for x in t.split("\n")}:
        own, raw = " " + " ".join(word.findall(line.lower())) + " ", line.lower().encode()
        sizes = [(len(plain.compress(raw)) - len(c.compress(raw)), n) for n, w, c in held if w in own]
        found = [f.license for f in scanner.scan(line) if f.agreement == 1.0 and "SPDX" not in line]
        if sizes:
            met += 1
            assert {n for s, n in sizes if s == max(sizes)[0]} & set(found), line
    assert met > 30
