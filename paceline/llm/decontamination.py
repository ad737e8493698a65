"""Benchmark decontamination as a prefix-filtered set join.

A window of an item (ten words, or the whole of a shorter item) is a set of word shingles. Shingles are ordered by
how many places of the corpus hold them, rarest first. A document that contains the window contains all of its
shingles, so the necessary prefix is its single rarest shingle: documents are joined with those alone. The length and
position of the shingle inside the window bound where the window must lie in the document, and every candidate is
verified word by word, byte by byte, over that item-sized window.

Benchmarks are small next to a corpus. They are taken in blocks of at most ``block`` windows, each sent to the
executors whole; more blocks mean more passes over the documents, never fewer windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import words
from paceline.llm.rows import shared, table

# Fixed values of the contract: words of a window; and words of a shingle
WINDOW = 10
SHINGLE = 3
# Hits verified together, and bits of the filter in front of the prefix search
TOGETHER = 20_000
FILTER = 22


class Windows:
    """The windows of some items, as arrays."""

    def __init__(self, items: list[tuple[str, str]]):
        self.names = [name for name, _ in items]
        raw = "\x00".join(text for _, text in items).encode().translate(words.LOWER)
        self.data = np.frombuffer(raw, np.uint8)
        sizes = [len(text.encode()) + 1 for _, text in items]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        offsets[-1] = len(raw)
        self.starts, self.ends, bounds = words.spans(self.data, offsets, words.ALNUM)
        self.prints = words.word_prints(self.data, self.starts, self.ends)
        counts = np.diff(bounds)
        length = np.minimum(counts, WINDOW)
        per_item = np.where(counts > 0, counts - length + 1, 0)
        self.item = np.repeat(np.arange(len(items)), per_item)
        inner = np.arange(per_item.sum()) - np.repeat(np.cumsum(per_item) - per_item, per_item)
        self.first = bounds[:-1][self.item] + inner
        self.length = length[self.item]

    def shingles(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, windows, fingerprints (windows, places)) for each shingle size in use."""
        for n in range(1, SHINGLE + 1):
            for length in range(n, WINDOW + 1 if n == SHINGLE else n + 1):
                of = np.flatnonzero(self.length == length)
                if len(of):
                    grams = words.gram_prints(self.prints, n)
                    yield n, of, grams[self.first[of][:, None] + np.arange(length - n + 1)]

    def choose(self, counts: dict[tuple[int, int], int]) -> None:
        """Keep of each window the rarest shingle as its prefix."""
        found: dict[int, list] = {}
        for n, of, grams in self.shingles():
            frequency = np.array([[counts.get((n, g), 0) for g in row] for row in grams.tolist()])
            place = frequency.argmin(axis=1)
            found.setdefault(n, []).append((of, place, grams[np.arange(len(of)), place]))
        self.prefixes = []
        for n, parts in found.items():
            of, place, gram = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(gram, kind="stable")
            self.prefixes.append((n, gram[order], of[order], place[order], _filter(gram)))


def _filter(grams: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << FILTER, bool)
    bits[grams & np.uint64((1 << FILTER) - 1)] = True
    return bits


def _sought(grams: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(bits[grams & np.uint64((1 << FILTER) - 1)])


def _blocks(benchmark: DataFrame, key: str, text: str, block: int) -> Iterator[Windows]:
    items, n = [], 0
    rows = benchmark.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.col(f"`{text}`")).where(F.col(f"`{text}`").isNotNull())
    for name, content in rows.toLocalIterator():
        items.append((name, content))
        n += 1 + len(content) // 2
        if n >= block:
            yield Windows(items)
            items, n = [], 0
    if items:
        yield Windows(items)


def _count_shingles(docs: DataFrame, text: str, windows: Windows) -> dict[tuple[int, int], int]:
    """Places of all documents that hold each shingle of the windows."""
    wanted = {}
    for n, _, grams in windows.shingles():
        wanted[n] = np.union1d(wanted.get(n, np.zeros(0, np.uint64)), grams)
    sought = shared(docs.sparkSession, [(n, g, _filter(g)) for n, g in wanted.items()])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = sought()
        totals = [np.zeros(len(grams), np.int64) for _, grams, _ in mine]
        for batch in batches:
            for _, _, data, offsets in words.texts(batch.column(0)):
                starts, ends, _ = words.spans(data, offsets, words.ALNUM)
                prints = words.word_prints(data, starts, ends)
                for total, (n, grams, bits) in zip(totals, mine, strict=True):
                    found = words.gram_prints(prints, n)
                    found = found[_sought(found, bits)]
                    at = np.minimum(np.searchsorted(grams, found), len(grams) - 1)
                    np.add.at(total, at[grams[at] == found], 1)
        for total, (n, grams, _) in zip(totals, mine, strict=True):
            some = np.flatnonzero(total)
            yield pa.record_batch(
                {"n": np.full(len(some), n, np.int32), "gram": grams[some].view(np.int64), "places": total[some]}
            )

    counted = docs.select(F.col(f"`{text}`")).mapInArrow(count, "n int, gram long, places long")
    rows = counted.groupBy("n", "gram").agg(F.sum("places")).toLocalIterator()
    return {(n, gram % (1 << 64)): places for n, gram, places in rows}


def _verified(windows: Windows, data, starts, ends, prints, at, window) -> np.ndarray:
    """Which of the candidates (word ``at`` begins ``window``) hold the window exactly."""
    good = np.zeros(len(at), bool)
    for low in range(0, len(at), TOGETHER):
        a, w = at[low : low + TOGETHER], window[low : low + TOGETHER]
        length = windows.length[w]
        owner = np.repeat(np.arange(len(a)), length)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
        mine, theirs = a[owner] + step, windows.first[w][owner] + step
        size = ends[mine] - starts[mine]
        same = (prints[mine] == windows.prints[theirs]) & (size == windows.ends[theirs] - windows.starts[theirs])
        alive = np.bincount(owner, ~same, len(a)) == 0
        keep = alive[owner]
        owner, mine, theirs, size = owner[keep], mine[keep], theirs[keep], size[keep]
        byte = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differ = data[np.repeat(starts[mine], size) + byte] != windows.data[np.repeat(windows.starts[theirs], size) + byte]
        alive &= np.bincount(np.repeat(owner, size), differ, len(a)) == 0
        good[low : low + TOGETHER] = alive
    return good


def _hits(windows: Windows, data, offsets):
    """(bounds, first word, words, item) of all windows found in the texts of a piece."""
    starts, ends, bounds = words.spans(data, offsets, words.ALNUM)
    prints = words.word_prints(data, starts, ends)
    doc = words.owners(bounds)
    found = []
    for n, prefix, of, place, bits in windows.prefixes:
        grams = words.gram_prints(prints, n)
        spot = _sought(grams, bits)
        low, high = np.searchsorted(prefix, grams[spot], "left"), np.searchsorted(prefix, grams[spot], "right")
        many = high - low
        entry = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        at, window = np.repeat(spot, many) - place[entry], of[entry]
        # the window must lie inside the document that holds the shingle
        owner = doc[np.repeat(spot, many)]
        fits = (at >= bounds[owner]) & (at + windows.length[window] <= bounds[owner + 1])
        at, window = at[fits], window[fits]
        good = _verified(windows, data, starts, ends, prints, at, window)
        found.append((at[good], window[good]))
    at, window = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
    return bounds, doc, at, windows.length[window], windows.item[window]


def _marker(block, last: bool, names: list[str]):
    """Adds the found word spans (flat pairs) and item names of one block to each row."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = block()
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            spans = batch.column(1).to_pylist()
            items = batch.column(2).to_pylist()
            for low, high, data, offsets in words.texts(batch.column(0)):
                bounds, doc, at, length, item = _hits(windows, data, offsets)
                n_words[low:high] = np.diff(bounds)
                if not len(at):
                    continue
                cover = np.zeros(bounds[-1] + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + length, -1)
                covered = np.cumsum(cover)[:-1] > 0
                # runs end with their document
                edge = np.zeros(len(covered) + 1, bool)
                edge[bounds] = True
                begins = np.flatnonzero(covered & (edge[:-1] | ~np.concatenate([[False], covered[:-1]])))
                stops = np.flatnonzero(covered & (edge[1:] | ~np.concatenate([covered[1:], [False]]))) + 1
                for d, b, e in zip(doc[begins], begins - bounds[doc[begins]], stops - bounds[doc[begins]], strict=True):
                    spans[low + d] = [*spans[low + d], int(b), int(e)]
                for d, i in np.unique(np.stack([doc[at], item]), axis=1).T:
                    items[low + d] = [*items[low + d], windows.names[i]]
            columns = [
                batch.column(0),
                pa.array(spans, pa.list_(pa.int64())),
                pa.array(items, pa.list_(pa.string())),
                batch.column(3),
            ]
            if last:
                columns[0] = pa.array(n_words)
            yield pa.RecordBatch.from_arrays(columns, names)

    return mark


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of all blocks as one sorted list of disjoint spans, items as a sorted list, and their counts."""
    for batch in batches:
        spans, items, hit, shas = [], [], [], []
        for flat, names in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            out: list[int] = []
            for b, e in sorted(zip(flat[::2], flat[1::2], strict=True)):
                if out and b <= out[-1]:
                    out[-1] = max(out[-1], e)
                else:
                    out += [b, e]
            names = sorted(set(names))
            spans.append(out)
            items.append(names)
            hit.append(sum(out[1::2]) - sum(out[::2]))
            shas.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(spans, pa.list_(pa.int64())),
                pa.array(items, pa.list_(pa.string())),
                pa.array(hit, pa.int64()),
                pa.array(shas, pa.string()),
                batch.column(3),
            ],
            ["n_words", "spans", "items", "n_hit", "items_sha256", "record"],
        )


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", carry: list[str] | None = None,
    block: int = 500_000,
) -> DataFrame:
    """(n_words, spans, items, n_hit, items_sha256, record) of every row of ``docs``.

    ``spans`` holds first word and last word + 1 of each hit run, flat; ``items`` the ids of the items found, sorted
    as text (a null id is the empty text, a repeated id counts once); ``record`` the columns ``carry`` (default all) of
    the row, so their names cannot clash. Null and empty texts have no words; items without words occur nowhere; an
    empty benchmark hits nothing; repeated rows and ties get equal results. Texts are read whole.
    """
    spark = docs.sparkSession
    record = F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)]).alias("record")
    content = F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    rows = docs.select(content, F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"), record)
    schema = rows.schema
    kind = schema["record"].dataType.simpleString()
    blocks = list(_blocks(benchmark, item_key, item_text, block)) or [Windows([("", "")])]
    for number, windows in enumerate(blocks, 1):
        windows.choose(_count_shingles(docs, text, windows))
        last = number == len(blocks)
        mark = _marker(shared(spark, windows), last, ["n_words" if last else "text", "spans", "items", "record"])
        rows = rows.mapInArrow(mark, rows.schema if not last else f"n_words long, spans array<long>, items array<string>, record {kind}")
    return rows.mapInArrow(
        _merged, f"n_words long, spans array<long>, items array<string>, n_hit long, items_sha256 string, record {kind}"
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark."""
    return contamination(docs, benchmark).where("n_hit = 0").select("record.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        F.col("record.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items_sha256",
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op3_decontamination": op3_decontamination}
SQL = {
    "op3_decontamination": r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents
    ), i AS (
        SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark WHERE text IS NOT NULL
    ), iw AS (
        SELECT item_id, least(10, len(w)) AS n, w, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS p FROM i WHERE len(w) > 0
    ), ik AS (
        SELECT DISTINCT item_id, n, array_to_string(w[p + 1 : p + n], ' ') AS k FROM iw
    ), sizes AS (
        SELECT DISTINCT n FROM ik
    ), dp AS (
        SELECT doc_id, n, w, unnest(range(0, len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n
    ), hits AS (
        SELECT doc_id, p, dk.n, item_id
        FROM (SELECT doc_id, n, p, array_to_string(w[p + 1 : p + n], ' ') AS k FROM dp) dk JOIN ik ON dk.k = ik.k AND dk.n = ik.n
    ), places AS (
        SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS at FROM hits) GROUP BY doc_id
    ), names AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
    )
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN places USING (doc_id) LEFT JOIN names USING (doc_id)
    """
}
