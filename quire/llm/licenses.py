"""License scan: conditional compression ranks templates, exact wording differences confirm the winner."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, line long, license string, reduction double, status string, missing array<string>, added array<string>"
#: (licence, wording) that blocks are compared with. Public notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This software is released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
]
#: A line with one of these is a candidate, with the lines about it that a notice wrapped over lines can reach.
CUES = ("licen", "rights reserved", "copyright", "permission", "redistribution", "public domain", "spdx", "creative commons", "cc by", "cc0")
#: Share of a template's words that may differ, and the words that may not: names, versions and conditions.
TOLERANCE = 0.25
_BINDING = re.compile(r"\d|^(?:mit|apache|bsd|isc|gnu|gpl|lgpl|agpl|lesser|affero|mozilla|mpl|cc|cc0|by|nc|nd|sa|public|domain|rights|reserved|attribution|not|non)$")
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
#: The same where a line ends, or a comment's mark stands, between the words of a cue.
_CUE = re.compile("|".join(r"\W+".join(map(re.escape, c.split())) for c in CUES))
#: Words before or after a cue that a notice can reach: the longest template's, with those that may be added.
REACH = int(max(len(_WORD.findall(t)) for _, t in TEMPLATES) * (1 + TOLERANCE)) + 1
#: Characters of a block beyond which it is compared piece by piece.
PIECE = 4096


def words(text: str) -> list[str]:
    """Lower-case words, in one spelling of licence."""
    return _WORD.findall(text.lower().replace("licenc", "licens"))


@cache
def _coders():
    plain = zstandard.ZstdCompressor(level=19, write_content_size=False)
    own = [zstandard.ZstdCompressor(level=19, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t in TEMPLATES]
    return plain, own


def ranked(block: str) -> list[tuple[float, int]]:
    """(size reduction, template) of every template as raw dictionary for ``block``, best first."""
    plain, own = _coders()
    data = block.lower().encode("utf-8", "surrogatepass")
    base = len(plain.compress(data))
    return sorted(((1 - len(c.compress(data)) / base, i) for i, c in enumerate(own)), key=lambda x: (-x[0], x[1]))


def differences(block: str, template: str) -> tuple[list[str], list[str]]:
    """Words of the template that the block misses, and words of the block that it adds, in order."""
    a, b = words(template), words(block)
    missing, added = [], []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op != "equal":
            missing += a[i:j]
            added += b[k:m]
    return missing, added


def identify(block: str) -> tuple[str | None, float, str, list[str], list[str]]:
    """(license, reduction, status, missing, added) of one block.

    All templates are compared word by word, those with the greatest reductions first; of the confirmed ones the one
    with the fewest differences wins. exact: no difference. modified: within ``TOLERANCE`` of the template's words and no
    binding word among the differences; a longer block may add words around a template that it holds whole.
    unconfirmed: neither; the best-ranked template's differences are given and license is null.
    """
    order = ranked(block)
    best = None
    for reduction, i in order:
        name, template = TEMPLATES[i]
        missing, added = differences(block, template)
        n = len(words(template))
        binding = any(_BINDING.search(w) for w in missing)
        close = len(missing) + len(added) <= TOLERANCE * n and not any(_BINDING.search(w) for w in added)
        status = "exact" if not missing and not added else "modified" if not binding and close else "contained" if not missing else "unconfirmed"
        rank = (("exact", "modified", "contained", "unconfirmed").index(status), len(missing) + len(added) if status != "contained" else -n, len(missing) + len(added))
        if best is None or rank < best[0]:
            best = rank, (name if status != "unconfirmed" else None, reduction, status, missing, added)
        if status == "exact":
            break
    return best[1]


def blocks(text: str | None) -> Iterator[tuple[int, str]]:
    """(line number, block): lines with a cue; very long lines piece by piece, cut at blanks."""
    if not text or not any(c in (low := text.lower()) for c in CUES):
        return
    for i, (line, lower) in enumerate(zip(text.split("\n"), low.split("\n"), strict=False)):
        if not any(c in lower for c in CUES):
            continue
        while len(line) > PIECE:
            cut = line.rfind(" ", PIECE // 2, PIECE)
            cut = cut if cut > 0 else PIECE
            piece, line = line[:cut], line[max(0, cut - PIECE // 4) :] if len(line) - cut > PIECE // 4 else line[cut:]
            if any(c in piece.lower() for c in CUES):
                yield i, piece
        if any(c in line.lower() for c in CUES):
            yield i, line


@cache
def _wordings() -> list[tuple[list[str], frozenset[str]]]:
    return [(w, frozenset(w)) for w in (words(t) for _, t in TEMPLATES)]


def occurrences(text: list[str]) -> list[tuple[int, int, int, list[str], list[str]]]:
    """[start, end) of each notice in ``text`` (words), its template, the words it misses and those it adds.

    Every template is compared with every stretch of its length that shares enough words with it. Of notices that
    overlap the one with more of a template's words stays, then the one with fewer differences.
    """
    found = []
    for t, (own, kinds) in enumerate(_wordings()):
        n, hits = len(own), [0]
        for w in text:
            hits.append(hits[-1] + (w in kinds))
        least, more = n - int(TOLERANCE * n), int(TOLERANCE * n)
        share = [hits[min(len(text), i + n)] - hits[i] for i in range(len(text))]
        at, free = 0, 0
        while at < len(text):
            if share[at] < least - more or text[at] not in kinds:
                at += 1
                continue
            start = max(free, at)
            ops = difflib.SequenceMatcher(None, own, text[start : start + n + more], autojunk=False).get_matching_blocks()[:-1]
            if sum(m.size for m in ops) < least:
                at += 1
                continue
            first, last = start + ops[0].b, start + ops[-1].b + ops[-1].size
            missing, added = own[: ops[0].a] + own[ops[-1].a + ops[-1].size :], []
            for x, y in zip(ops, ops[1:], strict=False):
                missing += own[x.a + x.size : y.a]
                added += text[start + x.b + x.size : start + y.b]
            # a word in place of a missing first or last one, like another version, is a difference too
            added += text[max(0, first - ops[0].a) : first] + text[last : last + n - ops[-1].a - ops[-1].size]
            if len(missing) + len(added) <= TOLERANCE * n and not any(_BINDING.search(w) for w in missing + added):
                found.append((first, last, t, missing, added))
                at = free = last
            else:
                at += 1
    found.sort(key=lambda x: (len(x[3]) - len(_wordings()[x[2]][0]), len(x[3]) + len(x[4]), x[0], x[2]))
    taken, out = set(), []
    for x in found:
        if taken.isdisjoint(range(x[0], x[1])):
            taken.update(range(x[0], x[1]))
            out.append(x)
    return sorted(out)


class _Lines(dict):
    """Words of each line that is asked for."""

    def __init__(self, lines: list[str]):
        self.lines = lines

    def __missing__(self, i: int) -> list[str]:
        self[i] = w = words(self.lines[i])
        return w


def notices(text: str | None) -> Iterator[tuple]:
    """(line, license, reduction, status, missing, added) of each notice, and of each block with a cue but no notice.

    A notice may run over lines, comment marks between them included, but not over a blank one. exact and contained
    are told by the other words of its lines.
    """
    if not text or not _CUE.search(low := text.lower()):
        return
    lines, cue, line, at = text.split("\n"), [], 0, 0
    for m in _CUE.finditer(low):
        line, at = line + low.count("\n", at, m.start()), m.start()
        cue.append(line)
    own = _Lines(lines)
    near = set()
    for i in dict.fromkeys(cue):
        near.add(i)
        for step in (1, -1):
            j, reached = i + step, 0
            while 0 <= j < len(lines) and own[j] and reached < REACH:
                near.add(j)
                reached += len(own[j])
                j += step
    covered, rows, run = set(), [], []
    for i in [*sorted(near), None]:
        if run and (i is None or i != run[-1] + 1 or not own[i]):
            flat, at = [w for j in run for w in own[j]], [j for j in run for _ in own[j]]
            for start, end, t, missing, added in occurrences(flat):
                covered.update(at[start:end])
                first, last = at[start], at[end - 1]
                before = next(k for k in range(start, -1, -1) if k == 0 or at[k - 1] != first)
                after = next(k for k in range(end, len(at) + 1) if k == len(at) or at[k] != last)
                around = flat[before:start] + flat[end:after]
                status = "modified" if missing or added else "contained" if around else "exact"
                block = " ".join(lines[first : last + 1]) if after - before <= PIECE // 8 else " ".join(flat[start:end])
                rows.append((first, TEMPLATES[t][0], dict((k, r) for r, k in ranked(block))[t], status, missing, around if status == "contained" else added))
            run = []
        if i is not None:
            run.append(i)
    rows += [(i, *identify(block)) for i, block in blocks(text) if i not in covered]
    yield from sorted(rows, key=lambda x: x[0])


def scan(docs: DataFrame) -> DataFrame:
    """One row a notice of ``docs`` (doc_id, text), or candidate block without one: doc_id, line, license, reduction,
    status, missing, added. ``line`` is where the notice begins.

    Documents without a candidate block, null and empty texts have no row; repeated rows and null ids are scanned
    like others; whole texts are read; other columns are ignored; an empty table gives no rows. Ties between
    templates go to the first.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(doc_id, *x) for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True) for x in notices(text.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
