"""License scans by sentence rules.

Sentences are normalised (lower case, letters and digits only; those with the name of a program or
holder begin after it) and looked up in a table of known licence sentences; each document becomes the sequence of the identifiers found, in order. Licence
rules are ordered sequences of identifiers; at each place the longest rule wins, and matched
identifiers are used up. Known sentences that no rule takes are reported as unmatched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, with_row

# Known licence sentences by identifier, as they stand in public licence texts.
SENTENCES = {
    "mit-ref": ["Released under the MIT License", "Licensed under the terms of the MIT License", "This project is licensed under the terms of the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "MIT License", "The MIT License (MIT)"],
    "mit-grant": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
    ],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-warranty": [
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'
    ],
    "mit-liability": [
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
    ],
    "apache-2-ref": ["Licensed under the Apache License, Version 2.0", "Apache License Version 2.0", "Apache License Version 2.0, January 2004", "Apache License, Version 2.0", "Released under the Apache License 2.0", 'Licensed under the Apache License, Version 2.0 (the "License")'],
    "apache-2-may": ["you may not use this file except in compliance with the License"],
    "apache-2-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache-2-as-is": [
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'
    ],
    "apache-2-see": ["See the License for the specific language governing permissions and limitations under the License"],
    "gpl-3-ref": ["This work is licensed under the GNU General Public License, version 3", "GNU General Public License version 3", "GNU General Public License Version 3, 29 June 2007", "Licensed under the GPLv3"],
    "gpl-2-ref": ["This work is licensed under the GNU General Public License, version 2", "GNU General Public License version 2", "GNU General Public License Version 2, June 1991", "Licensed under the GPLv2"],
    "gpl-free-2": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"
    ],
    "gpl-free-3": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ],
    "gpl-hope": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"
    ],
    "gpl-see": ["See the GNU General Public License for more details"],
    "lgpl-free-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"
    ],
    "lgpl-free-3": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ],
    "lgpl-see": ["See the GNU Lesser General Public License for more details"],
    "lgpl-2.1-ref": ["GNU Lesser General Public License version 2.1", "GNU Lesser General Public License Version 2.1, February 1999", "Licensed under the LGPLv2.1"],
    "lgpl-3-ref": ["GNU Lesser General Public License version 3", "GNU Lesser General Public License Version 3, 29 June 2007", "Licensed under the LGPLv3"],
    "agpl-free-3": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
    ],
    "agpl-see": ["See the GNU Affero General Public License for more details"],
    "agpl-3-ref": ["GNU Affero General Public License version 3", "GNU Affero General Public License Version 3, 19 November 2007", "Licensed under the AGPLv3"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"
    ],
    "bsd-endorse": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "bsd-warranty": [
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED'
    ],
    "isc-grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "isc-warranty": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'],
    "isc-ref": ["ISC License", "Licensed under the ISC License", "Released under the ISC License"],
    "mpl-2-subject": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "mpl-2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "mpl-2-ref": ["Mozilla Public License Version 2.0", "Mozilla Public License 2.0", "Licensed under the Mozilla Public License 2.0"],
    "epl-2-ref": [
        "Eclipse Public License - v 2.0",
        "Licensed under the Eclipse Public License 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "unlicense-free": ["This is free and unencumbered software released into the public domain"],
    "unlicense-anyone": [
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"
    ],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ],
    "bsl-1-ref": ["Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "bsd-2-ref": ["Licensed under the BSD 2-Clause License", "BSD 2-Clause License"],
    "bsd-3-ref": ["Licensed under the BSD 3-Clause License", "BSD 3-Clause License"],
    "cc-by-ref": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-ref": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-ref": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0-ref": ["CC0 1.0 Universal", "Licensed under CC0 1.0"],
    "mit-or-apache-ref": [
        "Dual licensed: MIT or Apache License 2.0",
        "Dual licensed under MIT or Apache-2.0",
        "Dual-licensed under the MIT license and the Apache License 2.0",
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option",
    ],
    "all-rights": ["All rights reserved"],
}

# Licence names of the SPDX list that tags and one-line notices name.
NAMES = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0",
    "EPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "MIT", "MIT-0", "MPL-2.0", "MS-PL", "Unlicense", "Zlib", "MIT OR Apache-2.0", "Apache-2.0 OR MIT",
)
#: How tags and notices name them; each is a known sentence of the identifier ``tag-`` and the name.
TAGS = ("SPDX-License-Identifier: {}", "License: {}", "License: {} License", "Licensed under {}", "Licensed under the {} License", "Released under the {} License", "This project is licensed under the {} License")

# Licence rules, ordered identifier sequences; of two that start alike the longer wins.
RULES = (
    ("MIT", ("mit-ref", "mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-ref",)),
    ("MIT OR Apache-2.0", ("mit-or-apache-ref",)),
    ("Apache-2.0", ("apache-2-ref", "apache-2-may", "apache-2-copy", "apache-2-as-is", "apache-2-see")),
    ("Apache-2.0", ("apache-2-ref",)),
    ("GPL-2.0-or-later", ("gpl-free-2", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl-free-2",)),
    ("GPL-3.0-or-later", ("gpl-free-3", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free-3",)),
    ("GPL-3.0", ("gpl-3-ref",)),
    ("GPL-2.0", ("gpl-2-ref",)),
    ("LGPL-2.1-or-later", ("lgpl-free-2.1", "gpl-hope", "lgpl-see")),
    ("LGPL-2.1-or-later", ("lgpl-free-2.1",)),
    ("LGPL-3.0-or-later", ("lgpl-free-3", "gpl-hope", "lgpl-see")),
    ("LGPL-3.0-or-later", ("lgpl-free-3",)),
    ("LGPL-2.1", ("lgpl-2.1-ref",)),
    ("LGPL-3.0", ("lgpl-3-ref",)),
    ("AGPL-3.0-or-later", ("agpl-free-3", "gpl-hope", "agpl-see")),
    ("AGPL-3.0-or-later", ("agpl-free-3",)),
    ("AGPL-3.0", ("agpl-3-ref",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-3-ref",)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", ("bsd-2-ref",)),
    ("ISC", ("isc-ref", "isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-ref",)),
    ("MPL-2.0", ("mpl-2-subject", "mpl-2-copy")),
    ("MPL-2.0", ("mpl-2-subject",)),
    ("MPL-2.0", ("mpl-2-ref",)),
    ("EPL-2.0", ("epl-2-ref",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-free",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", ("bsl-1-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
)
#: The tags' rules: each names its licence.
TAG_RULES = tuple((name, (f"tag-{name}",)) for name in NAMES)

#: Ends of sentences: a full stop, question or exclamation mark or semicolon before a blank, or a
#: line break. The point of a version number ends none.
ENDS = "[.!?;][\\x20\\x09-\\x0D]+|[.!?;]$|[\\x0A-\\x0D]+"
#: Where known sentences begin whose subject differs from text to text: the program in GNU notices,
#: the holder in BSD clauses. A name of any length, on lines of its own or not, stays before them.
ANCHORS = (("is", "free", "software"), ("is", "distributed", "in", "the", "hope"), ("nor", "the", "names", "of", "(?:its|any)"))


def normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9.]+|\\.(?![0-9])", " "))


def anchored(text: Column) -> Column:
    """``text`` in lower case with a line break before each anchor and none within, however it was wrapped."""
    out = low = F.lower(text)
    for words in ANCHORS:
        pattern = "(?<![a-z0-9])" + "[^a-z0-9]+".join(words) + "(?![a-z0-9])"
        stand_in = "\n" + " ".join(words[:-1] + ("its",) if "(" in words[-1] else words)
        there = F.contains(low, F.lit(words[-2])) & F.contains(low, F.lit(words[0] if "(" in words[-1] else words[-1]))
        out = F.when(there, F.regexp_replace(out, pattern, stand_in)).otherwise(out)
    return out


def pieces(text: Column) -> Column:
    """Normal sentences and lines."""
    return F.filter(F.transform(F.split(anchored(text), ENDS), normal), lambda x: x != "")


def _from_anchor(norm: Column) -> Column:
    starts = [" ".join(w[:-1] + ("its",) if "(" in w[-1] else w) for w in ANCHORS]
    first = lambda a: F.when(F.contains(norm, F.lit(a)), F.concat(F.lit(a), F.substring_index(norm, a, -1)))
    return F.coalesce(*map(first, starts), norm)


def known_sentences(spark: SparkSession, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """``norm, sentence_id``: the fixed table, with the caller's own sentences if any; sentences with an
    anchor begin there."""
    rows = [(s, k) for source in (SENTENCES, extra or {}) for k, group in source.items() for s in group]
    rows += [(form.format(name), f"tag-{name}") for name in NAMES for form in TAGS]
    listed = spark.createDataFrame(rows, "sentence string, sentence_id string")
    norms = listed.select(_from_anchor(F.array_join(pieces(F.col("sentence")), " ")).alias("norm"), F.monotonically_increasing_id().alias("at"), "sentence_id")
    return norms.groupBy("norm").agg(F.min_by("sentence_id", "at").alias("sentence_id"))  # the first of equal forms


def identifiers(docs: DataFrame, known: DataFrame, row: str = "row") -> DataFrame:
    """``row, doc_id, found``: for each row the known sentences in order, (place, lines, id).

    A sentence is looked up as it stands and joined with the following ones (wrapped lines), the
    longest known form from a place counting: no known sentence spans more pieces than it has words.
    Only places whose first two words open a known sentence go on. ``known`` is
    a table of rules, not of data, and is broadcast.
    """
    openings = F.broadcast(known.select(F.substring_index("norm", " ", 1).alias("first"), F.substring_index("norm", " ", 2).alias("opening"), F.size(F.split("norm", " ")).alias("most")).groupBy("first", "opening").agg(F.max("most").alias("most")))
    rows = with_row(docs.select("doc_id", text_or_empty("text").alias("text")), row)
    stream = rows.select(row, "doc_id", pieces(F.col("text")).alias("parts")).select(row, "doc_id", "parts", F.posexplode_outer("parts").alias("place", "part"))
    opens = (F.substring_index("part", " ", 1) == F.col("first")) & F.startswith(F.concat_ws(" ", "part", F.get("parts", F.col("place") + 1)), F.col("opening"))
    opened = stream.join(openings, opens, "left").filter("place IS NULL OR place = 0 OR opening IS NOT NULL")
    forms = F.when(F.col("opening").isNull(), F.array(F.struct(F.lit(0).alias("lines"), F.lit(None).cast("string").alias("form")))).otherwise(
        F.transform(F.sequence(F.lit(1), F.least(F.col("most"), F.size("parts") - F.col("place"))), lambda n: F.struct(n.alias("lines"), F.array_join(F.slice("parts", F.col("place") + 1, n), " ").alias("form")))
    )
    met = opened.select(row, "doc_id", "place", F.explode(forms).alias("f")).select(row, "doc_id", "place", "f.lines", "f.form")
    met = met.join(F.broadcast(known), met.form == known.norm, "left").filter("sentence_id IS NOT NULL OR lines <= 1")
    hit = F.when(F.col("sentence_id").isNotNull(), F.struct("place", "lines", "sentence_id"))
    return met.groupBy(row, "doc_id").agg(F.array_sort(F.collect_set(hit)).alias("found"))


def _disjoint(found: Column) -> Column:
    """From the first place on, the longest known form at each place not yet taken."""
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<place:int,lines:int,sentence_id:string>>").alias("kept"))
    longest = F.filter(found, lambda a, i: ~F.coalesce(F.get(found, i + 1)["place"] == a["place"], F.lit(False)))  # sorted by place, then lines
    return F.aggregate(
        longest,
        start,
        lambda s, x: F.when(x["place"] < s["free"], s).otherwise(F.struct((x["place"] + x["lines"]).alias("free"), F.concat(s["kept"], F.array(x)).alias("kept"))),
        lambda s: s["kept"],
    )


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, rules=RULES + TAG_RULES, row: str = "row") -> DataFrame:
    """``row, doc_id, sentences, licenses, unmatched`` of every row of ``docs`` (a table scan with
    ``doc_id``, ``text``).

    ``sentences``: the known sentences in order (place, lines, sentence_id), places counted in
    sentences from 0. ``licenses``: names by the ordered rules, in order of the text, repeats
    included. ``unmatched``: identifiers that no rule took. A null or empty text has none; repeated
    rows each get a result; an empty table gives an empty one.
    """
    known = known_sentences(docs.sparkSession) if known is None else known
    seq = identifiers(docs, known, row).withColumn("sentences", _disjoint(F.col("found")))
    ids = F.transform("sentences", lambda s: s["sentence_id"])
    seq = seq.withColumn("ids", ids).withColumn("at", F.transform("ids", lambda _, i: _match(i, rules)))
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("licenses"), F.array().cast("array<string>").alias("unmatched"), F.lit(0).alias("i"))
    fold = F.aggregate(
        F.arrays_zip("ids", "at"),
        start,
        lambda s, x: F.struct(
            F.when(s["i"] < s["free"], s["free"]).otherwise(s["i"] + F.coalesce(x["at"]["size"], F.lit(1))).alias("free"),
            F.when((s["i"] >= s["free"]) & x["at"].isNotNull(), F.concat(s["licenses"], F.array(x["at"]["name"]))).otherwise(s["licenses"]).alias("licenses"),
            F.when((s["i"] >= s["free"]) & x["at"].isNull(), F.concat(s["unmatched"], F.array(x["ids"]))).otherwise(s["unmatched"]).alias("unmatched"),
            (s["i"] + 1).alias("i"),
        ),
    )
    return seq.withColumn("out", fold).select(row, "doc_id", "sentences", "out.licenses", "out.unmatched")


def _match(i: Column, rules) -> Column:
    """Name and size of the longest rule that the column ``ids`` has from place ``i`` on."""
    names = F.create_map(*(F.lit(x) for name, rule in reversed(rules) for x in ("\x1f".join(rule), name)))
    options = []
    for n in sorted({len(rule) for _, rule in rules}, reverse=True):
        name = F.try_element_at(names, F.array_join(F.slice("ids", i + 1, n), "\x1f"))
        options.append(F.when(name.isNotNull() & (F.size("ids") - i >= n), F.struct(name.alias("name"), F.lit(n).alias("size"))))
    return F.coalesce(*options)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences, licences by the rules and left-over sentences of every document. Null
    and empty texts have none; repeated rows each have a result; of sentences that start at one place
    the longest counts; an empty table gives no rows."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("sentences").cast("long").alias("n_sentences"),
        F.array_join(F.transform("sentences", lambda s: s["sentence_id"]), ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        F.array_join("unmatched", ",").alias("unmatched"),
    )


QUERIES = {"op6_license_scan": op6_license_scan}
#: Ordered rules fold over sequences; tests compare with a plain-Python version.
ORACLES: dict = {}
