"""Licence recognition by sentences and ordered rules.

A text is cut into sentences (at line ends and after full stops), which are normalised to lower-case words. A known sentence
becomes its identifier wherever it stands, also behind other words and across the ends of wrapped lines: the first
words of all known sentences are an index by hash, so a text is read once however many sentences are known, and what the
index finds is compared word by word. Longer sentences are taken first. The short forms of ``SHORT`` have to be a sentence up to
its end, and before them may only stand words that end in a form of "to be". Any other sentence is a blank. A rule is a
list of steps in order, each a set of identifiers that may stand there, with at most ``gap`` blanks between steps; it names
a licence. Rules are tried in order, longer ones first, and the sentences a match has used are blanks for the rules after
it, so a full licence text is not also reported as its first sentence.

Every known sentence holds one of a few anchor words. Texts without any of them have no licence and never leave the JVM.
All is done within the row: nothing is shuffled and copies need no care. The registry of sentences is a parameter; it grows
with the number of licences and not with the data.

Null and empty texts have no sentences. Repeated rows each get their result. An empty table gives an empty result. Very
long texts are read as a whole. Columns of the input are kept in the struct ``row``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lotline.llm.common import packed, text_of

GAP = 3
INDEXED = 3
"""So many first words of a sentence are looked up together."""
TO_BE = frozenset(("is", "are", "was", "were", "be", "been", "being"))
BETWEEN = frozenset(("also", "now", "hereby", "dual"))
PIECE = re.compile(r"[^\W_]+|(?:\r?\n)+|(?<=[.;])[\x20\t]+|(?<=[^\W\d_])\.(?=[^\W\d_])")
"""A word, a cut, or a full stop inside a word."""

# Normalised licence sentences by identifier.
SENTENCES = {
    "apache-short": "licensed under the apache license version 2 0",
    "apache-1": "licensed under the apache license version 2 0 the license",
    "apache-2": "you may not use this file except in compliance with the license",
    "apache-3": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "mit-short": "released under the mit license",
    "mit-short-2": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-1": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit-2": "the above copyright notice and this permission notice shall be included in all copies or "
             "substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied",
    "gpl3-short": "this work is licensed under the gnu general public license version 3",
    "gpl-1": "this program is free software you can redistribute it and or modify it under the terms of the "
             "gnu general public license as published by the free software foundation",
    "gpl-2": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-v3": "either version 3 of the license or at your option any later version",
    "gpl-v2": "either version 2 of the license or at your option any later version",
    "bsd-1": "redistribution and use in source and binary forms with or without modification are permitted "
             "provided that the following conditions are met",
    "bsd-2": "redistributions of source code must retain the above copyright notice",
    "bsd-3": "redistributions in binary form must reproduce the above copyright notice",
    "bsd-4": "neither the name of the copyright holder nor the names of its contributors may be used to endorse "
             "or promote products derived from this software without specific prior written permission",
    "by-nc-short": "licensed under cc by nc 4 0",
    "by-short": "licensed under cc by 4 0",
    "by-sa-short": "licensed under cc by sa 4 0",
    "mit-title-2": "mit license",
    "mit-1-full": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                  "documentation files the software to deal in the software without restriction including without limitation the "
                  "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
                  "persons to whom the software is furnished to do so subject to the following conditions",
    "as-is-full": "the software is provided as is without warranty of any kind express or implied including but not limited to the "
                  "warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl-v3-full": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
                   "license as published by the free software foundation either version 3 of the license or at your option any "
                   "later version",
    "gpl-v2-full": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
                   "license as published by the free software foundation either version 2 of the license or at your option any "
                   "later version",
    "bsd-2-full": "redistributions of source code must retain the above copyright notice this list of conditions and the following "
                  "disclaimer",
    "bsd-3-full": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
                  "following disclaimer in the documentation and or other materials provided with the distribution",
    "apache-3-https": "you may obtain a copy of the license at https www apache org licenses license 2 0",
    "mpl2-1": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "gpl2-short": "licensed under the gnu general public license version 2",
    "gpl2-short-2": "released under the gnu general public license version 2",
    "gpl3-short-2": "licensed under the gnu general public license version 3",
    "gpl3-short-3": "released under the gnu general public license version 3",
    "lgpl2-1-full": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
                    "general public license as published by the free software foundation either version 2 1 of the license or "
                    "at your option any later version",
    "lgpl3-full": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
                  "general public license as published by the free software foundation either version 3 of the license or "
                  "at your option any later version",
    "agpl3-full": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero "
                  "general public license as published by the free software foundation either version 3 of the license or "
                  "at your option any later version",
    "isc-1": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
             "granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-2": "the software is provided as is and the author disclaims all warranties with regard to this software including "
             "all implied warranties of merchantability and fitness",
    "unlicense-1": "this is free and unencumbered software released into the public domain",
    "cc0-1": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights "
             "to this software to the public domain worldwide",
}

# Names of licences as tags give them.
TAGS = ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0",
        "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only",
        "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT",
        "MPL-2.0", "Unlicense", "Zlib")
SENTENCES |= {f"tag-{tag}": "spdx license identifier " + " ".join(re.findall("[a-z0-9]+", tag.lower())) for tag in TAGS}

SHORT = frozenset(("apache-short", "apache-1", "mit-short", "mit-short-2", "mit-title", "mit-title-2", "gpl3-short",
                   "by-nc-short", "by-short", "by-sa-short", "gpl2-short", "gpl2-short-2", "gpl3-short-2", "gpl3-short-3"))


@dataclass(frozen=True)
class Rule:
    license: str
    steps: tuple[tuple[str, ...], ...]

    def __post_init__(self):
        if not self.steps or not all(self.steps):
            raise ValueError(f"{self.license}: a rule needs steps, and a step needs sentences")


RULES = (
    Rule("Apache-2.0", (("apache-1", "apache-short"), ("apache-2",), ("apache-3", "apache-3-https"))),
    Rule("Apache-2.0", (("apache-1", "apache-short"), ("apache-2",))),
    Rule("BSD-3-Clause", (("bsd-1",), ("bsd-2-full", "bsd-2"), ("bsd-3-full", "bsd-3"), ("bsd-4",))),
    Rule("BSD-2-Clause", (("bsd-1",), ("bsd-2-full", "bsd-2"), ("bsd-3-full", "bsd-3"))),
    Rule("MIT", (("mit-1-full", "mit-1"), ("mit-2",), ("as-is-full", "as-is"))),
    Rule("MIT", (("mit-title", "mit-title-2", "mit-short", "mit-short-2"), ("mit-1-full", "mit-1"))),
    Rule("GPL-3.0-or-later", (("gpl-1",), ("gpl-v3",), ("gpl-2",))),
    Rule("GPL-3.0-or-later", (("gpl-1",), ("gpl-v3",))),
    Rule("GPL-2.0-or-later", (("gpl-1",), ("gpl-v2",))),
    Rule("GPL-3.0-or-later", (("gpl-v3-full",), ("gpl-2",))),
    Rule("GPL-2.0-or-later", (("gpl-v2-full",), ("gpl-2",))),
    Rule("GPL-3.0-or-later", (("gpl-v3-full",),)),
    Rule("GPL-2.0-or-later", (("gpl-v2-full",),)),
    Rule("Apache-2.0", (("apache-short", "apache-1"),)),
    Rule("MIT", (("mit-short", "mit-short-2"),)),
    Rule("MIT", (("mit-1-full", "mit-1"),)),
    Rule("GPL-3.0-only", (("gpl3-short",),)),
    Rule("CC-BY-NC-4.0", (("by-nc-short",),)),
    Rule("CC-BY-SA-4.0", (("by-sa-short",),)),
    Rule("CC-BY-4.0", (("by-short",),)),
    Rule("MPL-2.0", (("mpl2-1",),)),
    Rule("GPL-2.0-only", (("gpl2-short", "gpl2-short-2"),)),
    Rule("GPL-3.0-only", (("gpl3-short-2", "gpl3-short-3"),)),
    Rule("LGPL-2.1-or-later", (("lgpl2-1-full",),)),
    Rule("LGPL-3.0-or-later", (("lgpl3-full",),)),
    Rule("AGPL-3.0-or-later", (("agpl3-full",),)),
    Rule("ISC", (("isc-1",), ("isc-2",))),
    Rule("ISC", (("isc-1",),)),
    Rule("Unlicense", (("unlicense-1",),)),
    Rule("CC0-1.0", (("cc0-1",),)),
    *[Rule(tag, ((f"tag-{tag}",),)) for tag in TAGS],
)


def anchors(sentences: dict[str, str]) -> list[str]:
    """A few long words of which every sentence holds one."""
    left, out = [set(words.split()) for words in sentences.values()], []
    while left:
        counts = Counter(word for words in left for word in words if len(word) > 6) or Counter(w for ws in left for w in ws)
        out.append(max(counts, key=lambda word: (counts[word], word)))
        left = [words for words in left if out[-1] not in words]
    return out


class Registry:
    """Sentences and rules, ready to read texts."""

    def __init__(self, sentences: dict[str, str], rules: tuple[Rule, ...], gap: int):
        unknown = {s for rule in rules for step in rule.steps for s in step} - set(sentences)
        if unknown:
            raise ValueError(f"rules name unknown sentences: {sorted(unknown)}")
        ordered = sorted(((name, words.split()) for name, words in sentences.items()), key=lambda x: -len(x[1]))
        self.index: dict[tuple, list] = {}
        for rank, (name, words) in enumerate(ordered):
            self.index.setdefault(tuple(words[:INDEXED]), []).append((rank, name, words))
        self.widths = sorted({len(key) for key in self.index})
        self.rules = [(rule.license, re.compile(self._pattern(rule, gap))) for rule in sorted(rules, key=lambda r: -len(r.steps))]

    @staticmethod
    def _pattern(rule: Rule, gap: int) -> str:
        steps = ["(?:" + "|".join(f"<{re.escape(s)}>" for s in step) + ")" for step in rule.steps]
        return (r"\.{0,%d}" % gap).join(steps)

    def sentence_ids(self, text: str) -> str:
        """The text as a string of ``<identifier>`` and, for other sentences, dots; empty if none is known."""
        words, cut, glued = [], [True], [False]  # what stands before each word, and behind the last
        for piece in PIECE.findall(text.lower()):
            if piece == ".":
                glued[-1] = True
            elif piece[0] in "\r\n\t ":
                cut[-1] = True
            else:
                words.append(piece)
                cut.append(False)
                glued.append(False)
        cut[-1] = True
        found = []
        for width in self.widths:
            for at in range(len(words) - width + 1):
                for rank, name, known in self.index.get(tuple(words[at:at + width]), ()):
                    end = at + len(known)
                    if not glued[at] and not glued[min(end, len(words))] and words[at:end] == known:
                        found.append((rank, at, end, name))
        if not found:
            return ""
        taken: dict[int, tuple] = {}  # by word
        for rank, at, end, name in sorted(found):
            if any(k in taken for k in range(at, end)):
                continue
            if name in SHORT and not (cut[end] and (cut[at] or self._is_said(words, cut, glued, taken, at))):
                continue
            taken.update((k, (at, end, name)) for k in range(at, end))
        out, piece, filled = [], [], False
        for k in range(len(words) + 1):
            place = taken.get(k)
            if cut[k] and (place is None or place[0] == k):  # the end of a sentence, not within a known one
                out += piece or (["."] if filled else [])
                piece, filled = [], False
            filled = True
            if place and place[0] == k:
                piece.append(f"<{place[2]}>")
        return "".join(out) if taken else ""

    @staticmethod
    def _is_said(words: list, cut: list, glued: list, taken: dict, at: int) -> bool:
        """Whether a form of "to be", and maybe a word between, stands right before."""
        if at and not glued[at] and words[at - 1] in BETWEEN and at - 1 not in taken and not cut[at - 1]:
            at -= 1
        return at > 0 and not glued[at] and not cut[at] and words[at - 1] in TO_BE and at - 1 not in taken

    def read(self, text: str) -> tuple[int, int, list[str]]:
        """Known sentences, rule matches, and the names of the licences."""
        left = self.sentence_ids(text)
        sentences, total, names = left.count("<"), 0, set()
        for name, pattern in self.rules if left else ():
            left, n = pattern.subn(".", left)
            total += n
            if n:
                names.add(name)
        return sentences, total, sorted(names)


def licenses(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: tuple[Rule, ...] = RULES,
             gap: int = GAP) -> DataFrame:
    """row (all columns of the input), n_sentences (known ones), n_licenses (rule matches) and licenses (names, by name)."""
    registry = Registry(sentences, rules, gap)

    @F.pandas_udf("n_sentences bigint, n_licenses bigint, licenses array<string>")
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([registry.read(text) if text else (0, 0, []) for text in texts], columns=["n_sentences", "n_licenses", "licenses"])

    lower = F.lower(text_of("text"))
    held: Column = F.lit(False)
    for word in anchors(sentences):
        held = held | lower.contains(word)
    out = docs.select(packed(docs).alias("row"), read(F.when(held, F.col("text"))).alias("found"))
    return out.select("row", "found.*")
