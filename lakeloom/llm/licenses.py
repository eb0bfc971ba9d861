"""License scans by patience alignment with known notices.

Text and notice are aligned: words that are unique on both sides are anchors, the longest increasing run of them
stays, and the gaps between anchors are aligned in the same way. Coverage is the share of the notice's words that
are aligned. A place with enough coverage misses so few words that it has one at least of the notice's seeds, which
are one more than that: its rarest words among all notices. Windows around seeds are aligned.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names, key words (seeds in any case) and texts of license notices.
NOTICES = (
    ("Apache-2.0", "apache", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "Licensed under the MIT License."),
    ("MIT", "sublicense", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "gnu", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "gnu", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "nc", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("GPL-2.0", "gnu", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "gnu", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "lesser", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "lesser", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "lesser", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "lesser", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "affero", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "affero", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "mozilla", "Licensed under the Mozilla Public License, Version 2.0."),
    ("ISC", "isc", "Released under the ISC License."),
    ("ISC", "fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC0-1.0", "cc0", "Licensed under CC0 1.0 Universal."),
    ("CC0-1.0", "dedication", "This work is marked with the Creative Commons CC0 1.0 Universal Public Domain Dedication."),
    ("CC-BY-4.0", "by", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "sa", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "sharealike", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "unencumbered", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSD", "redistributions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
)
WORD = re.compile(r"[a-z0-9]+")
MIN_COVERAGE = 0.8
MIN_DENSITY = 0.6


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs sorted by their first number, the longest run whose second numbers increase (patience piles)."""
    tops, piles, back = [], [], []
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[at], piles[at] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[str], notice: list[str]) -> list[tuple[int, int]]:
    """Aligned positions (in text, in notice), increasing in both. Gaps wait on a list, so depth is no matter."""
    out, gaps = [], [(0, len(text), 0, len(notice))]
    while gaps:
        a, z, c, e = gaps.pop()
        while a < z and c < e and text[a] == notice[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < z and c < e and text[z - 1] == notice[e - 1]:
            z, e = z - 1, e - 1
            out.append((z, e))
        if a >= z or c >= e:
            continue
        here, there = Counter(text[a:z]), Counter(notice[c:e])
        where = {w: i for i, w in enumerate(notice[c:e], c) if there[w] == 1 and here[w] == 1}
        run = longest_increasing([(i, where[w]) for i, w in enumerate(text[a:z], a) if w in where])
        if run:
            out += run
            for (i, j), (k, m) in zip([(a - 1, c - 1), *run], [*run, (z, e)]):
                gaps.append((i + 1, k, j + 1, m))
    return sorted(out)


@dataclass(frozen=True)
class Notice:
    name: str
    words: list[str]
    counts: Counter
    needed: int  # aligned words that MIN_COVERAGE asks for
    slack: int  # words between aligned ones that MIN_DENSITY allows


def prepared() -> tuple[list[Notice], dict[str, list[tuple[int, int]]]]:
    """Notices, and of each seed word its notices and places in them."""
    out, at = [], {}
    texts = [WORD.findall(notice.lower()) for _, _, notice in NOTICES]
    spread = Counter(w for words in texts for w in set(words))
    for i, ((name, key, _), words) in enumerate(zip(NOTICES, texts)):
        needed = next(x for x in range(len(words) + 1) if x / len(words) >= MIN_COVERAGE)
        out.append(Notice(name, words, Counter(words), needed, int(len(words) * (1 / MIN_DENSITY - 1)) + 1))
        rarest = sorted(range(len(words)), key=lambda j: (words[j] != key, spread[words[j]], -len(words[j]), j))
        for j in rarest[: len(words) - needed + 1]:
            at.setdefault(words[j], []).append((i, j))
    return out, at


PREPARED, SEEDS = prepared()


def places(words: list[str], notice: Notice, starts: list[int]) -> list[tuple[int, int, int]]:
    """(aligned words, first, end) around each supposed start of the notice: within its length, and in wider windows."""
    out, n = [], len(notice.words)
    for start in starts:
        if out and start < out[-1][2] - n // 2 and out[-1][0] == n:
            continue  # a seed of the place before
        best = (0, 0, 0)
        for slack in (0, 2 + n // 4, notice.slack):
            low, high = max(0, start - slack), max(0, start + n + slack)
            here = Counter(words[low:high])
            if sum(min(c, here[w]) for w, c in notice.counts.items()) < notice.needed:
                continue
            pairs = align(words[low:high], notice.words)
            if len(pairs) < notice.needed or len(pairs) <= best[0]:
                continue
            if len(pairs) >= MIN_DENSITY * (pairs[-1][0] - pairs[0][0] + 1):
                best = (len(pairs), low + pairs[0][0], low + pairs[-1][0] + 1)
        if best[0]:
            out.append(best)
    return out


def scan(text: str | None) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, end word) of each place of a license, in the order of names and places.

    Of places that overlap, the one with the most aligned words stays, then that of the greatest coverage.
    """
    words = WORD.findall((text or "").lower())
    starts: dict[int, set[int]] = {}
    for i, w in enumerate(words):
        for notice, j in SEEDS.get(w, ()):
            starts.setdefault(notice, set()).add(i - j)
    have = Counter(words) if starts else Counter()
    found = []
    for i, some in starts.items():
        notice = PREPARED[i]
        if sum(min(c, have[w]) for w, c in notice.counts.items()) >= notice.needed:
            found += [(aligned, aligned / len(notice.words), notice.name, first, end) for aligned, first, end in places(words, notice, sorted(some))]
    taken = bytearray(len(words))
    out = []
    for _, coverage, name, first, end in sorted(set(found), key=lambda x: (-x[0], -x[1], x[4] - x[3], x[2], x[3])):
        if not any(taken[first:end]):
            taken[first:end] = b"\x01" * (end - first)
            out.append((name, coverage, first, end))
    return sorted(out, key=lambda x: (x[0], x[2]))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_licenses, licenses (comma-joined), coverage of the best, spans.

    spans lists license, coverage, first and end word of every place; places do not overlap. n_licenses counts places,
    licenses tells each license once. Null and empty texts have none; equal rows get equal results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                found = [scan(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(f) for f in found], pa.int32()), pa.array([",".join(sorted({x[0] for x in f})) for f in found]),
                        pa.array([max((x[1] for x in f), default=0.0) for f in found], pa.float64()),
                        pa.array([[dict(zip(("license", "coverage", "first", "end"), x)) for x in f] for f in found], kind),
                    ],
                    names=["doc_id", "n_licenses", "licenses", "coverage", "spans"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_licenses int, licenses string, coverage double, spans array<struct<license:string,coverage:double,first:long,end:long>>"
    )
