import re
import textwrap

from assay.llm import licenses
from assay.llm.queries import op4_license_scans
from tests.llm.conftest import ODD


def brute(text):
    """Families and their paragraphs by the driver's classifier, one paragraph after the other."""
    model = licenses.classifier()

    def family(paragraph):
        words = licenses.words_of(paragraph)
        p = model.probabilities(words)
        best = model.families[p.index(max(p))]
        pairs = set(zip(words, words[1:], strict=False))
        if best == licenses.UNKNOWN or max(p) < licenses.THRESHOLD:
            return None
        for t in licenses.TEMPLATES[best]:
            own = licenses.words_of(t)
            own = set(zip(own, own[1:], strict=False))
            if len(own & pairs) >= licenses.CONFIRM * len(own):
                return best, max(p)
        return None

    blocks, lines = [[]], re.sub("\r\n?", "\n", text or "").split("\n")
    for line, following in zip(lines, [*lines[1:], ""], strict=True):
        blocks[-1].append(line)
        goes_on = re.search(r"[^\s.!?][ \t]*$", line) and re.match(r"[ \t]*(?:[#*;/%!-]+[ \t]+)?[\w(\"'<]", following)
        if not goes_on or re.match(r"[ \t]*_", following):
            blocks.append([])
    out = []
    for block in filter(None, blocks):
        found = [f for f in map(family, block) if f]
        if not found and len(block) > 1:
            found = [f for f in [family(" ".join(block))] if f]
        out += found
    return out


def check(rows, texts):
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.licences == ",".join(sorted({f for f, _ in want})) and r.n_paragraphs == len(want), (r, want)
        assert (r.probability is None) == (not want)
        if want:
            assert abs(r.probability - min(p for _, p in want)) < 1e-9


def test_the_query_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op4_license_scans(spark, sf).collect()
    assert len(rows) == len(texts) and any(r.licences for r in rows)
    check(rows, texts)


def test_notices_and_near_misses(docs):
    pairs = [
        (1, "Some prose.\nReleased under the MIT License.\nmore"),
        (2, "All rights reserved."),
        (3, "licensed under the apache license, version 2.0"),
        (4, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3."),
        (5, "The driver's license was renewed under the general terms of the public office."),
        (6, "Licensed under the Quux License, version 9."),
        (7, "Released under the MIT License.\nReleased under the MIT License."),
        (8, "prose that goes\non in the next line\nReleased under the MIT License.\r\nmore"),
    ]
    rows = licenses.scan(docs(pairs)).collect()
    check(rows, dict(pairs))
    got = {r.doc_id: (r.licences, r.n_paragraphs) for r in rows}
    assert got[1] == ("MIT", 1) and got[2] == ("proprietary", 1) and got[3] == ("Apache-2.0", 1)
    assert got[4] == ("CC-BY-NC-4.0,GPL-3.0", 2) and got[5] == ("", 0) and got[7] == ("MIT", 2) and got[8] == ("MIT", 1)
    assert "MIT" not in got[6][0]


def test_odd_rows(docs):
    got = licenses.scan(docs([*ODD, (None, "All rights reserved."), (9, "x " * 100_000 + "\nAll rights reserved.")])).collect()
    assert sorted((str(r.doc_id), r.licences) for r in got if r.licences) == [("9", "proprietary"), ("None", "proprietary")]
    assert len(got) == len({i for i, _ in ODD}) + 1
    assert licenses.scan(docs([])).collect() == []


def test_every_template_is_recognised():
    model = licenses.classifier()
    for family, texts in licenses.TEMPLATES.items():
        for t in texts:
            p = model.probabilities(licenses.words_of(t))
            assert model.families[p.index(max(p))] == family and max(p) >= licenses.THRESHOLD, (t, max(p))
    for t in licenses.PLAIN:
        p = model.probabilities(licenses.words_of(t))
        assert model.families[p.index(max(p))] == licenses.UNKNOWN or max(p) < licenses.THRESHOLD


def test_wrapped_notices(docs):
    wrapped = {family: [textwrap.fill(t, 72) for t in texts] for family, texts in licenses.TEMPLATES.items()}
    pairs = [(family, w) for family, ws in wrapped.items() for w in ws if "\n" in w]
    texts = [(i, f"Some prose.\n\n{w}\n\nmore prose") for i, (_, w) in enumerate(pairs)]
    texts += [(1000 + i, "".join(f"# {x}\n" for x in w.split("\n"))) for i, (_, w) in enumerate(pairs)]
    got = {r.doc_id: r.licences for r in licenses.scan(docs(texts)).collect()}
    assert len(pairs) >= 10
    for i, (family, _) in enumerate(pairs):
        assert got[i] == family and got[1000 + i] == family, (pairs[i], got[i], got[1000 + i])
    plain = [(1, "The general told the public\nthat the software works.\nAll rights and duties are\nthe same for every member.")]
    assert [r.licences for r in licenses.scan(docs(plain)).collect()] == [""]


def test_wordings_that_were_not_trained_on(docs):
    """Recall on notices in other words, and quiet on prose about licences."""
    other = [
        ("MIT", "This project is released under the MIT License."),
        ("MIT", "The code is licensed under the MIT license, see LICENSE."),
        ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0 - see the file."),
        ("GPL-3.0", "The program is licensed under the GNU General Public License version 3 or later."),
        ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License v. 2.0"),
        ("BSD-3-Clause", "Redistribution and use of this data in source and binary forms, with or without modification, are permitted."),
        ("CC-BY-4.0", "All pictures here are licensed under CC BY 4.0 unless stated."),
        ("proprietary", "(c) 2019 Some Company Ltd. All rights reserved."),
    ]
    clean = ["A licence to fish costs ten crowns.", "The public library gives general advice.", "Apache is a web server.", "The rights were sold."]
    rows = {r.doc_id: r.licences for r in licenses.scan(docs([*enumerate(t for _, t in other), *((100 + i, t) for i, t in enumerate(clean))])).collect()}
    assert sum(rows[i] == f for i, (f, _) in enumerate(other)) >= 0.75 * len(other), rows
    assert not any(rows[100 + i] for i in range(len(clean)))
