"""Licence scan: passages of normalised text compared with licence templates by the Dice coefficient.

Passages are the whole text, its blocks, its lines and its sentences, once with every line break as an end and once with
wrapped lines joined, so that only lines without words (blank, spaces, CR, comment marks) end a block. Besides, spans of
words are compared wherever they stand: for each template, those that begin with one of its bigrams, hold at least its
words and are no longer than its size bound, whatever line breaks and marks lie between. A passage of a distinct word
bigrams and a template of b agree with at least ``least`` only if a lies between b * least / (2 - least) and
b * (2 - least) / least, so most templates drop out by size; a count of the passage's bigrams that occur in any template
then bounds the overlap from above. What remains is compared exactly, on the words themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import words
from paceline.llm.rows import table

# Licence id and text of each template (notices and grant or warranty paragraphs)
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
LEAST = 0.8
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
STOP = np.isin(np.arange(256), [ord(c) for c in ".!?"])
FILTER = 16
# Starts times lengths of spans that are compared together
CELLS = 1 << 20


def normal_words(text: str) -> list[str]:
    """Runs of letters, digits and all beyond ASCII, A-Z lower-cased."""
    data = np.frombuffer(text.encode().translate(words.LOWER), np.uint8)
    starts, ends, _ = words.spans(data, np.array([0, len(data)]), words.ALNUM)
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(starts, ends, strict=True)]


def bigrams(tokens: list) -> set:
    return set(zip(tokens, tokens[1:]))


def size_bounds(n: int, least: float) -> tuple[float, float]:
    """Sizes of the other set with which a set of ``n`` can reach the coefficient ``least``."""
    return n * least / (2 - least), n * (2 - least) / least


def _breaks(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Byte places where sentences, lines, blocks and texts begin; lines without words end blocks, too."""
    line = np.flatnonzero(data == 10)
    sentence = np.flatnonzero(STOP[data[:-1]] & SPACE[data[1:]]) + 1 if len(data) else line
    block = line[1:][np.diff(line) == 1] if len(line) else line
    wordless = line[1:][np.diff(np.searchsorted(starts, line)) == 0] if len(line) else line
    text = offsets[:-1]
    parts = (np.union1d(sentence, line), line, block, np.union1d(sentence, wordless), wordless)
    return [np.union1d(part, text) for part in parts] + [text]


def best_span(own: list, starts: np.ndarray, theirs: set, shortest: int, longest: int) -> float:
    """Best coefficient with ``theirs`` of the spans of ``own`` from ``starts`` with ``shortest`` to ``longest`` bigrams."""
    last: dict = {}
    before = np.empty(len(own), np.int64)
    for i, pair in enumerate(own):
        before[i] = last.get(pair, -1)
        last[pair] = i
    inside = np.array([pair in theirs for pair in own], bool)
    best, step = 0.0, max(1, CELLS // longest)
    for low in range(0, len(starts), step):
        first = starts[low : low + step, None]
        at = first + np.arange(longest)
        # a bigram counts where it comes first in the span; nothing comes after the end
        fresh = at < len(own)
        at = np.minimum(at, len(own) - 1)
        fresh &= before[at] < first
        dice = 2 * np.cumsum(fresh & inside[at], 1) / (np.cumsum(fresh, 1) + len(theirs))
        best = max(best, float(dice[:, shortest - 1 :].max()))
        if best == 1.0:
            break
    return best


def _scanner(templates, least: float):
    sets = [(name, bigrams([w.encode() for w in normal_words(text)])) for name, text in templates]
    smallest = min(len(s) for _, s in sets)
    low = size_bounds(smallest, least)[0]
    high = max(size_bounds(len(s), least)[1] for _, s in sets)
    known = np.zeros(1 << FILTER, bool)
    prints = []
    for _, text in templates:
        data = np.frombuffer(text.encode().translate(words.LOWER), np.uint8)
        starts, ends, _ = words.spans(data, np.array([0, len(data)]), words.ALNUM)
        pairs = words.gram_prints(words.word_prints(data, starts, ends), 2)
        known[pairs & np.uint64((1 << FILTER) - 1)] = True
        prints.append(pairs)
    vocabulary = np.unique(np.concatenate(prints))
    member = [np.isin(vocabulary, pairs) for pairs in prints]
    # (bigrams, fewest that a span shares, most bigrams of a span) of each template
    reach = []
    for (_, theirs), pairs in zip(sets, prints, strict=True):
        fewest, most = size_bounds(len(theirs), least)
        reach.append((len(pairs), max(1, math.ceil(fewest - 1e-9)), len(pairs) + int(most + 1e-9) - len(theirs)))

    def spans(pairs, bounds):
        """(text, template, starts, end) of the runs of bigrams that hold enough of a template's in its reach."""
        at = np.flatnonzero(known[pairs & np.uint64((1 << FILTER) - 1)])
        which = np.minimum(np.searchsorted(vocabulary, pairs[at]), len(vocabulary) - 1)
        text = np.searchsorted(bounds, at, "right") - 1
        real = (vocabulary[which] == pairs[at]) & (at + 1 < bounds[text + 1])
        at, which, text = at[real], which[real], text[real]
        for number, (shortest, fewest, longest) in enumerate(reach):
            mine = member[number][which]
            own, doc = at[mine], text[mine]
            ahead = slice(fewest - 1, None)
            k = np.flatnonzero((own[ahead] - own[: len(own[ahead])] < longest) & (doc[ahead] == doc[: len(own[ahead])]))
            if not len(k):
                continue
            own, doc = own[k], doc[k]
            end = bounds[doc + 1] - 1
            first = np.maximum(np.minimum(own, end - shortest), bounds[doc])
            cuts = np.flatnonzero((np.diff(first) > longest) | (np.diff(doc) > 0)) + 1
            for run in np.split(np.arange(len(k)), cuts):
                places = np.unique(first[run])
                yield int(doc[run[0]]), number, places, min(int(places[-1]) + longest, int(end[run[0]]))

    def passages(data, offsets):
        """Words, (text, first word, last word + 1) of the passages that can reach ``least`` with some template, and spans."""
        starts, ends, bounds = words.spans(data, offsets, words.ALNUM)
        if len(starts) < 2:
            return starts, ends, [], []
        pairs = words.gram_prints(words.word_prints(data, starts, ends), 2)
        hits = np.concatenate([[0], np.cumsum(known[pairs & np.uint64((1 << FILTER) - 1)])])
        found = set()
        for places in _breaks(data, offsets, starts):
            first = np.searchsorted(starts, places)
            last = np.append(first[1:], len(starts))
            size = last - first - 1
            # distinct bigrams are no more than bigrams, and those of templates no more than the hits
            # a passage without words may begin after the last word
            inside = hits[np.maximum(last - 1, 0)] - hits[np.minimum(first, len(hits) - 1)]
            # twice the overlap is at least this share of both sizes together
            can = (size >= low) & (2 * inside >= least * (low + smallest))
            for i in np.flatnonzero(can):
                found.add((int(np.searchsorted(offsets, places[i], "right")) - 1, int(first[i]), int(last[i])))
        return starts, ends, sorted(found), spans(pairs, bounds)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: list[dict] = [{} for _ in range(batch.num_rows)]
            for base, _, data, offsets in words.texts(batch.column(0)):
                starts, ends, found, runs = passages(data, offsets)
                raw = data.tobytes()
                for text, first, last in found:
                    own = bigrams([raw[starts[i] : ends[i]] for i in range(first, last)])
                    if not low <= len(own) <= high:
                        continue
                    for name, theirs in sets:
                        fewest, most = size_bounds(len(theirs), least)
                        if fewest <= len(own) <= most:
                            dice = 2 * len(own & theirs) / (len(own) + len(theirs))
                            if dice >= least:
                                row = best[base + text]
                                row[name] = max(row.get(name, 0.0), dice)
                for text, number, places, end in runs:
                    (name, theirs), row = sets[number], best[base + text]
                    if row.get(name) == 1.0:
                        continue
                    tokens = [raw[starts[i] : ends[i]] for i in range(places[0], end + 1)]
                    own = list(zip(tokens, tokens[1:]))
                    dice = best_span(own, places - places[0], theirs, reach[number][0], reach[number][2])
                    if dice >= least:
                        row[name] = max(row.get(name, 0.0), dice)
            names = [sorted(row) for row in best]
            scores = [max(row.values(), default=None) for row in best]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.list_(pa.string())), pa.array(scores, pa.float64()), batch.column(1)], ["licences", "dice", "record"]
            )

    return scan


def scan_licences(docs: DataFrame, templates=TEMPLATES, least: float = LEAST, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(licences, dice, record) of every row of ``docs``: sorted licence ids found, and the best coefficient.

    Null and empty texts and texts of one word have no bigrams and no licence (dice null). Several templates of one
    licence count once; ties all count. Texts are read whole; ``record`` holds the columns ``carry`` (default all), so
    names cannot clash; repeated rows get equal results. The templates are a fixed list in the code.
    """
    record = F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)]).alias("record")
    rows = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), record)
    kind = rows.schema["record"].dataType.simpleString()
    return rows.mapInArrow(_scanner(templates, least), f"licences array<string>, dice double, record {kind}")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        F.col("record.doc_id").alias("doc_id"), F.array_join("licences", ",").alias("licences"), "dice"
    )


def _sql() -> str:
    rows = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES)
    words_of = (
        "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    )
    pairs_of = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
    WITH t AS (
        SELECT name, {pairs_of} AS b FROM (SELECT name, {words_of.format("text")} AS w FROM (VALUES {rows}) v(name, text)) x
    ), d AS (
        SELECT doc_id, coalesce(text, '') AS text FROM documents
    ), seg AS (
        SELECT doc_id, text AS s FROM d
        UNION SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) FROM d
        UNION SELECT doc_id, unnest(string_split(text, chr(10))) FROM d
        UNION SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[\\x09-\\x0D\\x20]', '\\1' || chr(10), 'g'), chr(10))) FROM d
    ), sb AS (
        SELECT doc_id, {pairs_of} AS b FROM (SELECT doc_id, {words_of.format("s")} AS w FROM seg) x WHERE len(w) BETWEEN 2 AND 400
    ), m AS (
        SELECT doc_id, name, 2 * len(list_intersect(sb.b, t.b)) / (len(sb.b) + len(t.b)) AS dice
        FROM sb JOIN t ON len(sb.b) BETWEEN len(t.b) * {LEAST} / (2 - {LEAST}) AND len(t.b) * (2 - {LEAST}) / {LEAST}
        WHERE 2 * len(list_intersect(sb.b, t.b)) >= {LEAST} * (len(sb.b) + len(t.b))
    ), per AS (
        SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licences, max(dice) AS dice
        FROM (SELECT doc_id, name, max(dice) AS dice FROM m GROUP BY ALL) x GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(licences, '') AS licences, dice FROM d LEFT JOIN per USING (doc_id)
    """


QUERIES = {"op2_license_scan": op2_license_scan}
SQL = {"op2_license_scan": _sql()}
