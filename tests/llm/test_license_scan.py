import re
import textwrap

import pytest

from lotline.llm import license_scan as scan
from lotline.llm.queries import op7_license_scan


def brute(text):
    """Sentences, then rules one after the other over lists."""
    parts = [" ".join(re.findall(r"[^\W_]+", s.lower())) for s in re.split(r"(?:\r?\n)+|(?<=[.;])[ \t]+", text or "")]
    by_words = {words: name for name, words in scan.SENTENCES.items()}
    ids = [by_words.get(p) for p in parts if p]
    n_sentences = sum(i is not None for i in ids)
    names, total = set(), 0
    for rule in sorted(scan.RULES, key=lambda r: -len(r.steps)):
        at = 0
        while at < len(ids):
            used, here = [], at
            for k, step in enumerate(rule.steps):
                limit = here + (scan.GAP if k else 0)
                while here < len(ids) and ids[here] is None and k and here < limit:
                    here += 1
                if here >= len(ids) or ids[here] not in step:
                    break
                used.append(here)
                here += 1
            if len(used) == len(rule.steps):
                names.add(rule.license)
                total += 1
                ids[used[0]:here] = [None]
            at += 1
    return n_sentences, total, ",".join(sorted(names))


def sentence(name):
    return scan.SENTENCES[name].capitalize() + "."


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op7_license_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts) and sum(r.n_licenses for r in rows) > 20
    for r in rows:
        assert (r.n_sentences, r.n_licenses, r.licenses) == brute(texts[r.doc_id])


def test_rules_and_odd_rows(spark):
    full = "\n".join(map(sentence, ("bsd-1", "bsd-2", "bsd-3", "bsd-4")))
    texts = [None, "", "...\n;;", full, full.replace("\n", "\nother\n"), full.replace("\n", "\n" + "other\n" * 4),
             sentence("bsd-1") + " " + sentence("bsd-2") + "\n" + sentence("bsd-3"), sentence("bsd-3") + "\n" + sentence("bsd-1"),
             "LICENSED under the Apache-License,  Version 2.0.\r\nReleased under the MIT License.", "x " * 50_000,
             (sentence("mit-short") + "\n") * 300, sentence("gpl-1") + "\n" + sentence("gpl-v2") + sentence("gpl-2"),
             sentence("apache-short") + "\n" + sentence("apache-2"), "prefix " + sentence("mit-short")]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)] * 2 + [(None, full, None, None)],
                                 "doc_id bigint, text string, left string, n0 int")
    rows = scan.licenses(docs).collect()
    assert len(rows) == 2 * len(texts) + 1
    for r in rows:
        assert (r.n_sentences, r.n_licenses, ",".join(r.licenses)) == brute(r.row.text), r.row.text
    got = {r.row.doc_id: r.licenses for r in rows}
    assert got[3] == ["BSD-3-Clause"] and got[6] == ["BSD-2-Clause"] and got[5] == [] and got[8] == ["Apache-2.0", "MIT"]


def test_empty_table_and_wrong_rules(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert scan.licenses(docs).collect() == []
    with pytest.raises(ValueError):
        scan.licenses(docs, rules=(scan.Rule("X", (("none",),)),))
    with pytest.raises(ValueError):
        scan.Rule("X", ((),))


CANONICAL = {
    "MIT": """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    https://www.apache.org/licenses/LICENSE-2.0""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
CANONICAL |= {
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.""",
    "GPL-2.0-only": """It is licensed under the GNU General Public License version 2.""",
}
CANONICAL["BSD-2-Clause"] = CANONICAL["BSD-3-Clause"].split("\n\n3.")[0]


def test_standard_wordings_wrapped_and_not(spark):
    rows = []
    for name, text in CANONICAL.items():
        parts = text.split("\n\n")
        wrapped = ["\n".join(textwrap.wrap(p, 72)) for p in parts]
        rows += [(name, text), (name, " ".join(parts)), (name, "\n\n".join(wrapped)), (name, "\r\n".join("# " + x for w in wrapped for x in w.split("\n"))),
                 (name, "\n".join(textwrap.wrap(" ".join(parts), 40)))]
    rows += [("MIT", "This project is released under the MIT License."), ("", "It is not released under the MIT License."), ("MIT", "The code is\nlicensed under the\nMIT License.")]
    got = scan.licenses(spark.createDataFrame(rows, "want string, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert ",".join(r.licenses) == r.row.want, r.row.text


def test_tags_and_anchors(spark):
    rows = [("MIT", "SPDX-License-Identifier: MIT"), ("GPL-2.0-or-later", "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;"),
            ("BSD-3-Clause", "# spdx-license-identifier:  BSD-3-Clause"), ("", "SPDX-License-Identifier: Unknown-1.0"), ("", "a licence of no kind")]
    for r in scan.licenses(spark.createDataFrame(rows, "want string, text string")).collect():
        assert ",".join(r.licenses) == r.row.want, r.row.text
    anchors = scan.anchors(scan.SENTENCES)
    assert all(any(a in words.split() for a in anchors) for words in scan.SENTENCES.values()) and len(anchors) < 12
