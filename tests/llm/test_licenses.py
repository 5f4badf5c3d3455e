import re

import pytest

from flowloom.llm.licenses import NAMES, RULES, SENTENCES, TAG_RULES, TAGS, scan_licenses

ENDS = re.compile(r"[.!?;][\x20\x09-\x0D]+|[.!?;]\Z|[\x0A-\x0D]+")


def normal(s):
    return re.sub(r"[^a-z0-9.]+|\.(?![0-9])", " ", s.lower()).strip(" ")


FREE = re.compile(r"(?<![a-z0-9])is[^a-z0-9]+free[^a-z0-9]+software(?![a-z0-9])")
HOPE = re.compile(r"(?<![a-z0-9])is[^a-z0-9]+distributed[^a-z0-9]+in[^a-z0-9]+the[^a-z0-9]+hope(?![a-z0-9])")
HOLDER = re.compile(r"(?<![a-z0-9])nor[^a-z0-9]+the[^a-z0-9]+names[^a-z0-9]+of[^a-z0-9]+(?:its|any)(?![a-z0-9])")


def parts(text):
    low = HOLDER.sub("\nnor the names of its", HOPE.sub("\nis distributed in the hope", FREE.sub("\nis free software", (text or "").lower())))
    return [p for p in map(normal, ENDS.split(low)) if p]


def rule(sentence):
    p = parts(sentence)
    first = max((i for i, x in enumerate(p) if x.startswith(("is free software", "is distributed in the hope", "nor the names of its"))), default=0)
    return " ".join(p[first:])


KNOWN = {}
for k, group in [*SENTENCES.items(), *((f"tag-{n}", [t.format(n) for t in TAGS]) for n in NAMES)]:
    for s in group:
        KNOWN.setdefault(rule(s), k)


def slow(text):
    p, ids, i = parts(text), [], 0
    while i < len(p):
        best = max((n for n in range(1, 120) if i + n <= len(p) and " ".join(p[i : i + n]) in KNOWN), default=0)
        if best:
            ids.append(KNOWN[" ".join(p[i : i + best])])
        i += best or 1
    names, rest, i = [], [], 0
    while i < len(ids):
        hit = max(((len(r), n) for n, r in RULES + TAG_RULES if tuple(ids[i : i + len(r)]) == r), default=None)
        if hit:
            names.append(hit[1])
            i += hit[0]
        else:
            rest.append(ids[i])
            i += 1
    return ids, names, rest


def wrap(text, n):
    w = text.split()
    return "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))


def test_against_plain_python(docs, odd_rows):
    full = lambda *ids: ". ".join(SENTENCES[i][0] for i in ids) + "."
    mit = full("mit-ref", "mit-grant", "mit-notice", "mit-warranty", "mit-liability")
    texts = [
        "Some prose here. Released under the MIT License.",
        "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.",
        mit,
        wrap(mit, 14),
        "Intro.\n" + wrap(full("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), 12),
        full("bsd-grant", "bsd-source", "bsd-binary"),
        full("bsd-grant", "bsd-binary", "bsd-source"),
        full("gpl-free-3", "gpl-hope", "gpl-see") + " All rights reserved",
        "This work is licensed under the GNU General Public License, version 3. Version 3. MIT License",
        "released   UNDER the mit license!! MIT License",
        "The Released under the MIT License",
    ]
    rows = odd_rows + list(enumerate(texts, 100))
    got = scan_licenses(docs(rows, 3)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *slow(t)) for i, t in rows)
    assert sorted((str(r.doc_id), [s["sentence_id"] for s in r.sentences], r.licenses, r.unmatched) for r in got) == want
    by_id = {w[0]: w[2] for w in want}
    assert by_id["102"] == by_id["103"] == ["MIT"] and by_id["104"] == ["BSD-3-Clause"] and by_id["105"] == ["BSD-2-Clause"] and by_id["106"] == []
    assert scan_licenses(docs([])).count() == 0


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 13, 20])
def test_wrapped(docs, width):
    full = lambda *ids: ". ".join(SENTENCES[i][0] for i in ids) + "."
    rows = [(1, wrap(full("mit-grant", "mit-notice", "mit-warranty", "mit-liability"), width)), (2, wrap(full("gpl-free-3", "gpl-hope", "gpl-see"), width))]
    assert {r.doc_id: r.licenses for r in scan_licenses(docs(rows)).collect()} == {1: ["MIT"], 2: ["GPL-3.0-or-later"]}


def test_families(docs):
    full = lambda *ids: ". ".join(SENTENCES[i][0] for i in ids) + "."
    named = full("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse").replace("the copyright holder nor", "the University of Somewhere nor")
    free = full("gpl-free-3", "gpl-hope", "gpl-see").replace("This program", "Foo Bar")
    want = {
        named: ["BSD-3-Clause"],
        wrap(named, 9): ["BSD-3-Clause"],
        free: ["GPL-3.0-or-later"],
        full("isc-grant", "isc-warranty"): ["ISC"],
        wrap(full("mpl-2-subject", "mpl-2-copy"), 10): ["MPL-2.0"],
        wrap(full("lgpl-free-2.1", "gpl-hope", "lgpl-see"), 11): ["LGPL-2.1-or-later"],
        full("agpl-free-3", "gpl-hope", "agpl-see"): ["AGPL-3.0-or-later"],
        full("unlicense-free", "unlicense-anyone"): ["Unlicense"],
        "// SPDX-License-Identifier: Apache-2.0\nint x;": ["Apache-2.0"],
        "# SPDX-License-Identifier: MIT OR Apache-2.0\n": ["MIT OR Apache-2.0"],
        'name = "x"\nlicense = "BSD-3-Clause"\n': ["BSD-3-Clause"],
        "License: MIT": ["MIT"],
        "The licence of the MIT building": [],
    }
    rows = list(enumerate(want))
    got = {r.doc_id: r.licenses for r in scan_licenses(docs(rows)).collect()}
    assert got == {i: want[t] for i, t in rows} == {i: slow(t)[1] for i, t in rows}


def test_names_of_any_length_and_place(docs):
    full = lambda *ids: ". ".join(SENTENCES[i][0] for i in ids) + "."
    free, bsd = full("gpl-free-3", "gpl-hope", "gpl-see"), full("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")
    long = "The Very Long Name Of A Program That Somebody Wrote Once And Others Kept For Twenty Years Or More"
    want = {
        free.replace("This program is", "Foo Bar\nis"): ["GPL-3.0-or-later"],
        free.replace("This program is free software", f" * {long}\n * is free\n * software"): ["GPL-3.0-or-later"],
        free.replace("This program", long): ["GPL-3.0-or-later"],
        bsd.replace("the copyright holder nor", f"{long}\n{long}\nnor"): ["BSD-3-Clause"],
        "This project is licensed under the terms of the MIT license.": ["MIT"],
        "dual licensed: MIT or Apache License 2.0": ["MIT OR Apache-2.0"],
        "What it is. Free software is good": [],
    }
    rows = list(enumerate(want))
    got = {r.doc_id: r.licenses for r in scan_licenses(docs(rows)).collect()}
    assert got == {i: want[t] for i, t in rows} == {i: slow(t)[1] for i, t in rows}


def test_every_rule_wrapped_at_every_width_with_a_name_on_its_own_line(docs):
    rows = []
    for name, ids in RULES:
        text = ". ".join(SENTENCES[i][0] for i in ids) + "."
        text = re.sub("^This (program|library) is|(?<=[.] )This program is", "My Program\nis", text).replace("the copyright holder nor", "Some\nHolder nor")
        rows += [(name, "\n".join(wrap(line, width) for line in text.split("\n"))) for width in (1, 2, 4, 7, 11, 16)]
    got = {r.doc_id: r.licenses for r in scan_licenses(docs([(i, t) for i, (_, t) in enumerate(rows)])).collect()}
    assert got == {i: slow(t)[1] for i, (_, t) in enumerate(rows)}
    assert all(got[i][0] == name for i, (name, _) in enumerate(rows))
