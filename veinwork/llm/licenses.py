"""License texts in documents: winnowed fingerprints pick candidates, banded alignment measures them."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veinwork.llm.common import bounded_batches, id_type, keyed_text
from veinwork.llm.decontaminate import _Tokens, running_hashes

#: Tokens in a fingerprint, fingerprints in a winnowing window, how far an alignment may drift, least coverage.
GRAM, WINDOW, BAND, COVERAGE = 3, 4, 12, 0.8
_TOKEN = re.compile(r"[^\W_]+")

# Short notices, and notices and openings of public licenses.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("All-rights-reserved", "All rights reserved."),
    ("MIT-notice", "Released under the MIT License."),
    ("MIT-licensed", "Licensed under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-notice", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0-notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT-disclaimer", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause-third", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the fingerprints kept: the rightmost smallest hash of each window; all of fewer than a window."""
    if len(hashes) <= window:
        return np.arange(len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1))


def align(text: np.ndarray, template: np.ndarray, band: int = BAND) -> tuple[int, int, int]:
    """Most tokens that match in order, within band of the diagonal, and the text's places from the first to after
    the last of them; of equally good alignments the one that ends first and then begins last. text[0] lies band
    tokens before the expected start of the template.
    """
    width = 2 * band + 1
    best = [(0, 0, 0)] * (width + 1)  # matched, -end, start; by text place - template place
    for i, want in enumerate(template.tolist()):
        row = []
        for k in range(width):
            j = i + k
            # Skipping a template token moves one diagonal down: (i-1, j) lies on diagonal k + 1.
            options = [best[k + 1]] if k + 1 < width else [(0, 0, 0)]
            if k:
                options.append(row[k - 1])
            if j < len(text) and text[j] == want:
                m, _, s = best[k]
                options.append((m + 1, -(j + 1), s if m else j))
            row.append(max(options))
        best = [*row, (0, 0, 0)]
    m, end, start = max(best)
    return m, start, -end


class Index:
    """The templates' tokens, and their winnowed fingerprints by hash."""

    def __init__(self, templates: Sequence[tuple[str, str]], band: int = BAND):
        hashes = _Tokens()
        self.band = band
        self.names = [n for n, _ in templates]
        self.tokens = [hashes.of(t) for _, t in templates]
        self.places: dict[int, list[tuple[int, int]]] = {}
        for t, tokens in enumerate(self.tokens):
            h = running_hashes(tokens, GRAM)
            for p in winnow(h):
                self.places.setdefault(int(h[p]), []).append((t, int(p)))
        self.keys = np.array(sorted(self.places), dtype=np.uint64)

    def find(self, text: str, hashes: _Tokens, least: float) -> list[dict]:
        """Spans of the text that cover least or more of a template; of spans within each other the longest stay."""
        tokens = hashes.of(text)
        h = running_hashes(tokens, GRAM)
        hits = np.flatnonzero(np.isin(h, self.keys)) if len(h) else h
        if not len(hits):
            return []
        starts: dict[int, dict[int, list[int]]] = {}
        for p in hits.tolist():
            for t, q in self.places[int(h[p])]:
                starts.setdefault(t, {}).setdefault(p - q, []).append(p)
        spans = _token_spans(text)
        found = []
        for t, guesses in starts.items():
            want = self.tokens[t]
            open_ = np.isin(tokens, want)  # tokens that no alignment with this template has taken
            for guess, places in sorted(guesses.items()):
                low = guess - self.band
                at = np.arange(low, min(len(tokens), guess + len(want) + self.band))
                while any(open_[p] for p in places) and (free := (at >= 0) & open_[np.maximum(at, 0)]).sum() >= least * len(want):
                    m, first, end = align(np.where(free, tokens[np.maximum(at, 0)], 0), want, self.band)
                    if m < least * len(want):
                        break
                    a, b = low + first, low + end - 1
                    open_[a : b + 1] = False
                    found.append({"license_id": self.names[t], "start": spans[a][0], "end": spans[b][1], "matched_tokens": m, "template_tokens": len(want), "coverage": m / len(want)})
        found.sort(key=lambda f: (-f["matched_tokens"], -f["coverage"], f["start"], f["license_id"]))
        kept: list[dict] = []
        for f in found:
            if not any(f["start"] < k["end"] and k["start"] < f["end"] for k in kept):
                kept.append(f)
        return sorted(kept, key=lambda f: (f["start"], f["license_id"]))


def _token_spans(text: str) -> list[tuple[int, int]]:
    """Places of the tokens in the text itself; lower-casing can lengthen it, so each character keeps its own place."""
    low = text.lower()
    if len(low) == len(text):
        return [m.span() for m in _TOKEN.finditer(low)]
    place = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
    place += [len(text)] * (len(low) + 1 - len(place))
    return [(place[m.start()], place[m.end() - 1] + 1) for m in _TOKEN.finditer(low)]


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", band: int = BAND) -> DataFrame:
    """One row per license text found: id, license_id, start, end (code points), matched_tokens, template_tokens, coverage.

    band: how many tokens an alignment may drift, so an edit that is longer parts a template in two. templates: (name, text) pairs, a list that fits in memory; their winnowed fingerprints are the index, and
    every fingerprint of a document's whole text is looked up in it, so a match of GRAM + WINDOW - 1 tokens
    is never missed. Each diagonal that a hit points to is aligned with its template within a band, again and again while
    tokens are left there that no alignment took, so notices that follow one another closely are found each.
    Null and empty texts have no rows; repeated rows have theirs each; an empty table gives no rows; ties
    between templates over one place go to more matched tokens, then coverage, then name. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = keyed_text(docs, id_col, text_col)
    fields = [("license_id", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched_tokens", pa.int64()), ("template_tokens", pa.int64()), ("coverage", pa.float64())]
    schema = pa.schema([("id", id_type(rows)), *fields])
    pairs = tuple(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes = Index(pairs, band), _Tokens()
        for b in batches:
            out = [(i, f) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for f in index.find(t, hashes, least)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], schema[0].type), *(pa.array([f[n] for _, f in out], k) for n, k in fields)], schema=schema)

    ddl = f"id {rows.schema['id'].dataType.simpleString()}, license_id string, start bigint, end bigint, matched_tokens bigint, template_tokens bigint, coverage double"
    return rows.mapInArrow(run, ddl).withColumnRenamed("id", id_col)
