"""License scans by conditional compression and wording.

Around each hint, a block of each template's own length is compressed with the template as a raw zstandard dictionary. Templates are ranked
by the bytes that this saves, and the winners are confirmed, best first, by the exact differences in wording."""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_of

#: Public licence notices in their usual wording.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-notice": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0-notice": "Licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-notice": "Licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
}
#: Identifiers that a source line may name.
SPDX = [
    "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "AGPL-3.0-only", "MPL-2.0", "EPL-2.0", "ISC", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "Unlicense",
]
TEMPLATES |= {f"SPDX:{name}": f"SPDX-License-Identifier: {name}" for name in SPDX}
#: What makes a place a candidate; templates without such a word need theirs added.
HINT = r"(?i)licen[sc]|copyright|permission is hereby|redistribution and use|gnu general|spdx|free software"
#: Share of template words that may be missing or changed. Words with a digit may not, and none of the words that tell licences apart may come in.
CHANGED = 0.15
APART = {"lesser", "library", "affero", "not", "no"}
_WORD = re.compile(r"[^\W_]+(?:[.\-+'/][^\W_]+)*")


def plain_words(text: str) -> list[str]:
    """Lower-case words without the signs around them; 2.0 is 2."""
    return [_plain(m[0]) for m in _WORD.finditer(text)]


def _plain(word: str) -> str:
    low = word.lower()
    return low[:-2] if low.endswith(".0") and low[:-2].isdigit() else low


def differences(block: list[str], template: list[str]) -> tuple[int, list[str], tuple[int, int]]:
    """Template words missing or changed, the differences as -word and +word within the matched stretch, and that stretch of the block.
    A change that makes it another licence counts as all words."""
    same = difflib.SequenceMatcher(None, template, block, autojunk=False)
    runs = [m for m in same.get_matching_blocks() if m.size]
    if not runs:
        return len(template), [f"-{w}" for w in template], (0, 0)
    first, last = runs[0], runs[-1]
    low, high = max(0, first.b - first.a), min(len(block), last.b + last.size + len(template) - last.a - last.size)
    diff, missing, other = [], 0, False
    for op, a, b, c, d in difflib.SequenceMatcher(None, template, block[low:high], autojunk=False).get_opcodes():
        if op != "equal":
            gone, new = template[a:b], block[low:high][c:d]
            missing += max(len(gone), len(new))
            other |= any(ch.isdigit() for w in gone for ch in w) or not APART.isdisjoint(set(new) | set(gone))
            diff += [f"-{w}" for w in gone] + [f"+{w}" for w in new]
    return len(template) if other else missing, diff, (low, high)


class Scanner:
    def __init__(self, templates: dict[str, str], hint: str = HINT):
        import zstandard

        self.hint = re.compile(hint)
        self.words = {k: w for k, v in templates.items() if (w := plain_words(v))}
        self.counts = {k: Counter(w) for k, w in self.words.items()}
        self.plain = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
        self.with_template, self.own = {}, {}
        for k, w in self.words.items():
            given = zstandard.ZstdCompressionDict(" ".join(w).encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            given.precompute_compress(level=3)
            self.with_template[k] = zstandard.ZstdCompressor(write_checksum=False, write_content_size=False, dict_data=given, level=3)
            self.own[k] = max(1, self.saved(k, w))

    def saved(self, name: str, block: list[str]) -> int:
        """Bytes by which the template as a dictionary makes the block smaller."""
        raw = " ".join(block).encode("utf-8", "surrogatepass")
        return len(self.plain.compress(raw)) - len(self.with_template[name].compress(raw))

    def scan(self, text: str) -> list[tuple[int, str, float, int, list[str]]]:
        """(place, licence, gain, words changed, differences): at each hint, templates in the order of the bytes that they save on their block; each
        winner is confirmed by wording and keeps its words to itself.

        A block has a template's own length on either side of the hint, so the text around a notice doesn't matter. Templates that share too few words
        with it to be confirmed aren't compressed."""
        spans = [m.span() for m in _WORD.finditer(text)]
        words = [_plain(text[a:b]) for a, b in spans]
        ranked: dict[tuple, tuple] = {}
        k, last = 0, -1
        for hit in self.hint.finditer(text):
            while k < len(spans) and spans[k][1] <= hit.start():
                k += 1
            if k == last:
                continue
            last = k
            for name, template in self.words.items():
                slack = int(CHANGED * len(template)) + 1
                begin = max(0, k - len(template) - slack)
                block = words[begin : k + len(template) + slack]
                if (Counter(block) & self.counts[name]).total() < len(template) * (1 - CHANGED):
                    continue
                # no floor: in prose, the shortest notices save next to nothing
                saved = self.saved(name, block)
                for low, high, missing, diff in self.confirmed(template, block):
                    place = (name, begin + low, begin + high)
                    ranked[place] = min(ranked.get(place, (math.inf,)), (-saved, missing, round(saved / self.own[name], 4), diff))
        out, taken = [], []
        for (name, low, high), (_, missing, gain, diff) in sorted(ranked.items(), key=lambda x: (x[1][:2], x[0])):
            if all(high <= a or low >= b for a, b in taken):
                taken.append((low, high))
                out.append((spans[low][0], name, gain, missing, list(diff)))
        return sorted(out)

    def confirmed(self, template: list[str], block: list[str]) -> set[tuple]:
        """(first word, end, words changed, differences) where the template lies in the block."""
        n, most = len(template), CHANGED * len(template)
        slack = int(most) + 1
        out = set()
        for m in difflib.SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks()[:-1]:
            low = max(0, m.b - m.a - slack)  # the template's place by this run, and as much around it as may be changed
            missing, diff, (a, b) = differences(block[low : m.b - m.a + n + slack], template)
            if missing <= most:
                out.add((low + a, low + b, missing, tuple(diff)))
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, hint: str = HINT) -> DataFrame:
    """doc_id, at (code point), license, gain, n_changed, differences: licence notices in whole texts, one row for each. gain: bytes that the
    template saves on the block, as a share of what it saves on itself.

    Null and empty texts and texts without a hint give no row; repeated rows are reported as often as they come; of overlapping finds, the one
    that saves the most bytes stays, then that with the fewest changes, then by the template's name; an empty table gives an empty table.
    Documents without a hint never reach Python."""
    own = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(own, hint)
        for batch in batches:
            rows = [(d, *r) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in scanner.scan(t)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "at", "license", "gain", "n_changed", "differences"])

    near = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).where(F.col("text").rlike(hint))
    return map_batches(near, run, "doc_id long, at long, license string, gain double, n_changed int, differences array<string>")
