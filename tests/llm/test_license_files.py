"""Complete LICENSE files, with title and holder, and texts that only look like their heads."""

import pytest

from corpusmill.llm.licenses import TEXTS
from corpusmill.llm.license_scan import scan_licenses

TITLES = {"BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" License'], "MIT": ["MIT License", "The MIT License (MIT)", "# MIT License"], "ISC": ["ISC License", "The ISC License"], "BSD-2-Clause": ["BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The 2-Clause BSD License", "Simplified BSD License"], "Zlib": ["zlib License", "The zlib/libpng License"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD"]}
HOLDERS = ["Copyright (c) 2020 Jane Doe", "Copyright Jane Doe", "copyright The Authors. All rights reserved.", "© Jane Doe", None]


@pytest.fixture(scope="module")
def found(spark):
    files = {}
    for name, titles in TITLES.items():
        for title in titles:
            for holder in HOLDERS:
                head = [x for x in (title, holder) if x]
                files["\n\n".join([*head, TEXTS[name]])] = name
                files["\r\n".join([*reversed(head), "", TEXTS[name]])] = name
    texts = TEXTS["BSD-2-Clause"]
    wrapped = texts.replace("THE COPYRIGHT HOLDER OR", "THE\nCOPYRIGHT HOLDER OR")
    assert wrapped != texts
    files[wrapped] = "BSD-2-Clause"
    files["MIT License"] = files["Notes on the MIT License\n\n" + TEXTS["MIT"]] = files["Copyright Holders Be Warned\n\n" + TEXTS["MIT"]] = None
    rows = list(files.items())
    got = scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()
    return {rows[x.id]: x for x in got}


def test_whole_license_files(found):
    assert {k: x.text_license for k, x in found.items() if x.text_license != k[1]} == {}


def test_a_title_alone_keeps_its_digest(found):
    assert found["MIT License", None].text_digest is not None


def test_digests_of_public_files(spark):
    """The digests that come with the library against the texts, where the system has them."""
    import os

    from corpusmill.llm.licenses import DIGESTS
    from corpusmill.llm.license_scan import digests_of

    folder = "/usr/share/common-licenses"
    if not os.path.isdir(folder):
        pytest.skip("no licence files on this system")
    known = {d for ds in DIGESTS.values() for d in ds}
    got = {x.name: x.digest for x in digests_of(spark, folder).collect()}
    names = {"Apache-2.0", "Artistic", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-1.1", "MPL-2.0"}
    assert {n: got[n] in known for n in names & set(got)} == dict.fromkeys(names & set(got), True)


def brute_digest(text):
    """The canonical form by plain Python, without title lines."""
    import hashlib
    import re

    from corpusmill.llm.license_scan import COPYRIGHT_LINE, SPELLINGS

    plain = re.sub(COPYRIGHT_LINE, "", text or "")
    plain = " " + re.sub("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ", plain.lower()).strip(" ") + " "
    for a, b in SPELLINGS:
        plain = plain.replace(f" {a} ", f" {b} ")
    return hashlib.sha256(plain.strip(" ").encode()).hexdigest() if plain.strip(" ") else None


def test_lookup_against_plain_python(spark, monkeypatch):
    """Broadcast and salted lookups, a line that a third of all documents share, documents that share an id."""
    from corpusmill.llm import license_scan
    from corpusmill.llm.licenses import TAGS

    notice = "// SPDX-License-Identifier: MIT"
    texts = [(i % 50, f"text {i}\n{notice if i % 3 == 0 else 'and no more'}\n\n  {'# SPDX-License-Identifier: ' + TAGS[i % len(TAGS)] if i % 7 == 0 else ''}") for i in range(300)] + [(400, TEXTS["Unlicense"]), (401, TEXTS["BSD-3-Clause"]), (402, None), (403, "")]
    names = {brute_digest(t): k for k, t in license_scan._pairs()}
    want = sorted((i, brute_digest(t), names.get(brute_digest(t)), sorted({names[d] for d in map(brute_digest, (t or "").split("\n")) if d in names})) for i, t in texts)
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    for limit in (100_000, 3):
        monkeypatch.setattr(license_scan, "BROADCAST_ROWS", limit)
        got = sorted((x.id, x.text_digest, x.text_license, x.line_licenses) for x in license_scan.scan_licenses(frame).collect())
        assert [str(x) for x in got] == [str(x) for x in want]
    kept = {(x.doc_id, x.text) for x in license_scan.drop_licensed(frame, ["MIT"]).collect()}
    assert kept == {(i, t) for (i, t) in texts if "MIT" not in (names.get(brute_digest(t)), *(names.get(brute_digest(x)) for x in (t or "").split("\n")))}


def test_empty_tables(spark):
    from corpusmill.llm.license_scan import known_licenses, scan_licenses

    docs = spark.createDataFrame([(1, TEXTS["MIT"]), (2, None)], "doc_id long, text string")
    assert {(x.text_license, tuple(x.line_licenses)) for x in scan_licenses(docs, known_licenses(spark).where("false")).collect()} == {(None, ())}
    assert scan_licenses(docs.where("false")).count() == 0
