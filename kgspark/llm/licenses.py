"""License scans by conditional compression.

A paragraph is a candidate if it holds a word that license texts live by. Its words
are taken in windows of bounded length that overlap by any template with its allowed
additions, so a long paragraph is searched like a short one. Each window is
compressed with each template as a zstandard raw dictionary; how much smaller that
makes it gives the order in which templates are tried. All are tried: compression ranks
and drops nothing. Exact wording confirms: the alignment of a template's words in
order with the fewest missing and added ones. A window can have any number of
licenses. What a confirmed stretch itself saves ranks it, and of stretches that
overlap the one that saves most counts; differences and length part only equal savings.
SPDX tags are read as they stand, with any identifier.

Work is per row, so nothing is shuffled.

Defined cases: null and empty texts have no blocks and no findings. Blocks of any
length are taken whole. Repeated rows give their findings each. Empty tables
give no rows. Further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple, Optional

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from kgspark.llm.batches import text_chunks

#: Short license statements as they are put into documents, by identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "MPL-2.0": "This work is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ALL-RIGHTS": "Copyright. All rights reserved.",
}
_GNU = ("This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by "
        "the Free Software Foundation, either version {2} of the License, or (at your option) any later version.")
#: Further usual wordings: statements and notices, by identifier. The two clauses stand in all BSD licenses.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
            "in the documentation and/or other materials provided with the distribution."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                     "derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("GPL-2.0", _GNU.format("program", "", "2")),
    ("GPL-3.0", _GNU.format("program", "", "3")),
    ("LGPL-2.1", _GNU.format("library", "Lesser ", "2.1")),
    ("LGPL-3.0", _GNU.format("library", "Lesser ", "3")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Words that tell short templates apart, besides numbers.
NAMES = frozenset({"mit", "cc", "by-nc", "by-sa", "license", "reserved"})
#: A template of so many words, too few for ``CONFIRM`` to allow any difference, may lack one that is no name.
SHORT = range(4, 7)
#: A tag and the identifiers it names.
TAG = re.compile(r"spdx-license-identifier:[ \t]*(\(*[\w.+:-]+\)*(?:[ \t]+(?:and|or|with)[ \t]+\(*[\w.+:-]+\)*)*)", re.I)
#: Words of which a candidate has one.
CANDIDATE = re.compile(r"licen[sc]|copyright|spdx|reserved|redistribution|permission|mozilla|creative commons|public domain|\bcc[ -]?(?:by|0)", re.I)
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", re.I)
#: The share of a template's words that confirms.
CONFIRM = 0.85
LEVEL = 3
#: Words of a window, in lengths of the longest template with its additions (as many words again).
SPAN = 3


class Finding(NamedTuple):
    license: str
    saved: int          # bytes that the template's dictionary saves on the stretch
    matched: int        # template words found in order
    missing: list[str]  # template words that the block lacks
    extra: list[str]    # words that the block has among them


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


@lru_cache(maxsize=256)
def _packer(template: str) -> zstandard.ZstdCompressor:
    """A compressor with the template as its dictionary; none for an empty one."""
    raw = zstandard.ZstdCompressionDict(template.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) if template else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_checksum=False, write_dict_id=False)


def saving(stretch: str, template: str) -> int:
    """Bytes that the template's dictionary saves."""
    data = stretch.lower().encode()
    return len(_packer("").compress(data)) - len(_packer(template).compress(data))


def _allowed(template: list[str]) -> int:
    """Words of the template that a confirmed stretch may lack."""
    return 1 if len(template) in SHORT else len(template) - math.ceil(CONFIRM * len(template))


def _needed(template: list[str]) -> set[str]:
    """Numbers and names tell licenses apart, so none may be missing."""
    return {w for w in template if any(c.isdigit() for c in w) or len(template) in SHORT and w in NAMES}


def _possible(own: set[str], template: list[str]) -> bool:
    """Whether a block of these words can have the template in any order; what cannot is not aligned."""
    return _needed(template) <= own and sum(w in own for w in template) >= len(template) - _allowed(template)


def wording(block: list[str], template: list[str]) -> Optional[tuple[int, int, list[str], list[str]]]:
    """(start, stop, missing, extra) of the stretch of the block that has the template with the fewest missing and added words."""
    spare, m, n, far = _allowed(template), len(template), len(block), 1 << 20
    needed = _needed(template)
    if not _possible(set(block), template):
        return None
    place = np.arange(n + 1)
    # cost[i][k, j]: fewest additions with the first i words met or missing, k of them missing, in a stretch that ends before word j.
    cost = [np.full((spare + 1, n + 1), far)]
    cost[0][0] = 0
    hits = []
    array = np.array(block, object)
    for w in template:
        old = cost[-1]
        hit = np.append(False, array == w)
        new = np.full_like(old, far)
        new[:, 1:] = np.where(hit[1:], old[:, :-1], far)
        if w not in needed:
            new[1:] = np.minimum(new[1:], old[:-1])
        new = np.minimum.accumulate(new - place, axis=1) + place
        hits.append(hit)
        cost.append(new)
    last = np.where(cost[-1] <= m, cost[-1] + np.arange(spare + 1)[:, None], far)
    if last.min() >= far:
        return None
    k, j = np.unravel_index(int(last.argmin()), last.shape)
    i, k, j = m, int(k), int(j)
    met, missing = [], []
    while i:
        now = cost[i][k, j]
        if hits[i - 1][j] and cost[i - 1][k, j - 1] == now:
            met.append(j - 1)
            i, j = i - 1, j - 1
        elif k and template[i - 1] not in needed and cost[i - 1][k - 1, j] == now:
            missing.append(template[i - 1])
            i, k = i - 1, k - 1
        else:
            j -= 1
    start, stop = met[-1], met[0] + 1
    held = set(met)
    return start, stop, missing[::-1], [block[x] for x in range(start, stop) if x not in held]


def stretches(block: list[str], template: list[str]) -> Iterator[tuple[int, int, list[str], list[str]]]:
    """All stretches of the block that have the template; none overlaps another."""
    open_parts = [(0, len(block))]
    while open_parts:
        a, b = open_parts.pop()
        if found := wording(block[a:b], template):
            start, stop, missing, extra = found
            yield a + start, a + stop, missing, extra
            open_parts += [(a, a + start), (a + stop, b)]


#: Identifier, text and words of every wording, and the words of the longest with its additions.
WORDINGS = [(name, text, words(text)) for name, text in [*TEMPLATES.items(), *NOTICES]]
LONGEST = 2 * max(len(w) for _, _, w in WORDINGS)


def ranked(window: list[str]) -> list[tuple[str, str, list[str]]]:
    """All wordings, those first whose dictionaries save most on the window."""
    text = " ".join(window)
    return sorted(WORDINGS, key=lambda w: -saving(text, w[1]))


def inspect(own: list[str]) -> list[tuple[int, Finding]]:
    """(first word, finding) of a block of words: those that save most first; none overlaps a better one."""
    found = {}
    for a in range(0, max(1, len(own) - LONGEST), (SPAN - 1) * LONGEST):
        window = own[a : a + SPAN * LONGEST]
        held = set(window)
        for at, (name, text, template) in enumerate(ranked(window)):
            if not _possible(held, template):
                continue
            for start, stop, missing, extra in stretches(window, template):
                saved = saving(" ".join(window[start:stop]), text)
                rank = (-saved, at, len(missing) + len(extra), len(missing) - len(template), name, a + start)
                found[rank] = (a + stop, Finding(name, saved, len(template) - len(missing), missing, extra))
    out, taken = [], set()
    for rank in sorted(found):
        stop, finding = found[rank]
        if taken.isdisjoint(range(rank[-1], stop)):
            taken.update(range(rank[-1], stop))
            out.append((rank[-1], finding))
    return sorted(out, key=lambda x: x[0])


def tags(line: str) -> Iterator[Finding]:
    """A finding for each identifier that an SPDX tag names, as it is written."""
    for tag in TAG.finditer(line):
        names = [w for w in re.split(r"[\s()]+", tag[1]) if w and w.lower() not in ("and", "or", "with")]
        for name in names:
            yield Finding(name, saving(tag[0], f"SPDX-License-Identifier: {name}"), 1 + len(words(name)), [], [])


def blocks(text: str) -> Iterator[tuple[list[int], list[str]]]:
    """(line number of each word, words) of the paragraphs that are candidates; blank lines part paragraphs."""
    for blank, lines in itertools.groupby(enumerate(text.split("\n")), lambda x: not x[1].strip()):
        lines = list(lines)
        # A name may be wrapped, so the lines are searched as one.
        if not blank and CANDIDATE.search(" ".join(line for _, line in lines)):
            own = [(i, w) for i, line in lines for w in words(line)]
            yield [i for i, _ in own], [w for _, w in own]


def findings(text: str) -> list[tuple[int, Finding]]:
    """(line it starts in, finding) of a text."""
    out = [(lines[at], hit) for lines, own in blocks(text) for at, hit in inspect(own)]
    if "spdx" in text.lower():
        out += [(i, hit) for i, line in enumerate(text.split("\n")) for hit in tags(line)]
    return sorted(out, key=lambda x: x[0])


_FOUND = "doc_id long, block int, license string, saved int, matched int, missing array<string>, extra array<string>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()))
    names = [c.split()[0] for c in _FOUND.split(", ")]
    for part, texts in text_chunks(batches):
        rows = []
        for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
            rows += [(doc_id, i, *hit) for i, hit in findings(text.decode())] if text else []
        columns = list(zip(*rows)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def scan(docs: DataFrame) -> DataFrame:
    """One row per confirmed stretch: doc_id, block (line it starts in), license, saved, matched, missing, extra."""
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(_scan, _FOUND)
