"""Removal of word runs that an earlier document holds: seed and extend.

Seeds are anchors of SEED words, winnowed so that every window of LENGTH words selects one by its content alone; equal
windows select the same anchor at the same place. Documents are joined on anchors. Of an anchor's occurrence only the
windows that selected it matter: with the anchor they make one context, which reaches as far to both sides as those
windows do.

* A context that occurs as a whole in an earlier document is repeated in all of its windows: one row of the distinct
  contexts answers for thousands of copies.
* One occurrence of every other context, in the earliest document that holds it, is extended from the seed to both
  sides, by every split of the missing words between left and right. Extensions that are equal meet under their
  fingerprint, and the earliest document among them decides. No pair of documents is formed, and an anchor that most
  documents share is only counted.

Adjoining windows merge into the maximal repeats whose words are removed. Anchors are known by 64 bits, where a
collision only adds work; contexts and windows by 128 bits of two unlike fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import words
from paceline.llm.rows import landed, locatable, table

# Fixed value of the contract: words of a window
LENGTH = 50
# Words of an anchor
SEED = 25
# Parts to which the rows of one anchor, context or window are dealt
SPREAD = 8

# Bytes weigh by their place in the word: a second fingerprint that has nothing in common with the first
_WEIGHTS = np.random.default_rng(13).integers(1, 1 << 63, (64, 256), dtype=np.uint64)


def _second_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of words, each a sum of weights of its bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    begin = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(begin, size)
    sums = np.add.reduceat(_WEIGHTS[place & 63, data[np.repeat(starts, size) + place]], begin)
    return words.mixed(sums ^ words.mixed(size.astype(np.uint64)))


def _run_sums(prints: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Sums from which the fingerprint of every run of words follows."""
    return np.append(np.uint64(0), np.cumsum(words.mixed(prints) * base[: len(prints)]))


def _run_prints(sums: np.ndarray, power: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return words.mixed((sums[high] - sums[low]) * power[low] + (high - low).astype(np.uint64))


class _Runs:
    """128-bit fingerprints of any run of words of some texts."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        up, down = words._POWERS.upto(len(starts) + 1)
        self.power = up
        self.first = words.word_prints(data, starts, ends)
        self.sums = [_run_sums(p, down) for p in (self.first, _second_prints(data, starts, ends))]

    def prints(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = (_run_prints(s, self.power, low, high) for s in self.sums)
        return one, two


def selected(prints: np.ndarray, bounds: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, anchor): first words of all windows and of the anchor that each selects, the last least one in it."""
    grams = words.gram_prints(prints, seed)
    per = np.maximum(np.diff(bounds) - length + 1, 0)
    window = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(bounds[:-1], per)
    reach = length - seed + 1
    n = len(grams)
    if not len(window):
        return window, window
    # least of ``reach`` keys from blocks read both ways; the place breaks ties towards the last
    key = (grams >> np.uint64(32) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    padded = np.full(-(-n // reach) * reach, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    blocks = padded.reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[window], ahead[window + reach - 1])
    return window, (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)


def _seeds(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Per text: (file, row, key, n_words, whole_sha256, seeds) with (anchor, context, low, high, at) of every seed.

    Windows that selected the seed start from word low to word high; at is the seed's first word.
    """
    inner = [("anchor", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("at", pa.int32())]
    for batch in batches:
        for base, top, data, offsets in words.texts(batch.column(3), lower=False):
            starts, ends, bounds = words.spans(data, offsets, words.NOT_SPACE)
            runs = _Runs(data, starts, ends)
            window, at = selected(runs.first, bounds, length, seed)
            owner = np.repeat(np.arange(top - base), np.maximum(np.diff(bounds) - length + 1, 0))
            fresh = np.ones(len(window), bool)
            fresh[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
            head = np.flatnonzero(fresh)
            low, high, at, owner = window[head], window[np.append(head[1:], len(window)) - 1] if len(head) else window, at[head], owner[head]
            anchor, _ = runs.prints(at, at + seed)
            one, two = runs.prints(low, high + length)
            # the same words around another place of the anchor are another context
            one = words.mixed(one + (at - low).astype(np.uint64) * words.BASE)
            begin = bounds[owner]
            columns = [anchor.view(np.int64), one.view(np.int64), two.view(np.int64)]
            columns += [(c - begin).astype(np.int32) for c in (low, high, at)]
            seeds = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=[n for n, _ in inner])
            place = pa.array(np.searchsorted(owner, np.arange(top - base + 1)).astype(np.int32))
            raw = data.tobytes()
            whole = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            cut = slice(base, top)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i)[cut] for i in range(3)), pa.array(np.diff(bounds)), pa.array(whole), pa.ListArray.from_arrays(place, seeds)],
                ["file", "row", "key", "n_words", "whole_sha256", "seeds"],
            )


def _extend(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(w1, w2, key, one, two, left): every listed seed extended to windows, ``left`` words before it.

    The words that a window has beyond its seed are split between both sides in every way the context allows.
    """
    for batch in batches:
        listed = batch.column(2)
        for base, top, data, offsets in words.texts(batch.column(0), lower=False):
            starts, ends, bounds = words.spans(data, offsets, words.NOT_SPACE)
            runs = _Runs(data, starts, ends)
            part = listed.slice(base, top - base)
            seeds = part.flatten()
            one, two, low, high, at = (seeds.field(n).to_numpy() for n in ("one", "two", "low", "high", "at"))
            text = np.repeat(np.arange(top - base), np.diff(part.offsets.to_numpy()))
            many = (high - low + 1).astype(np.int64)
            of = np.repeat(np.arange(len(many)), many)
            start = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            place = bounds[:-1][text[of]] + start
            w1, w2 = runs.prints(place, place + length)
            key = batch.column(1).take(pa.array(base + text[of]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), key, pa.array(one[of]), pa.array(two[of]), pa.array((at[of] - start).astype(np.int32))],
                ["w1", "w2", "key", "one", "two", "left"],
            )


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(file, row, spans, kept) of texts with the first words of their repeated windows."""
    for batch in batches:
        spans, kept = [], []
        for text, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            found = (text or "").encode().split()
            cover = np.zeros(len(found) + 1, np.int64)
            np.add.at(cover, [s["low"] for s in starts], 1)
            np.add.at(cover, [s["high"] + length for s in starts], -1)
            gone = np.cumsum(cover)[:-1] > 0
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            spans.append(np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).ravel().tolist())
            kept.append(b" ".join(found[i] for i in np.flatnonzero(~gone)).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.string())], ["file", "row", "spans", "kept"]
        )


def _dealt(few: DataFrame) -> DataFrame:
    """A table with one row per key, copied to every part that ``_part`` deals the many rows of a key to."""
    return few.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))


def _part(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SPREAD)).cast("int")


def repeated_words(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, spans, kept, whole_sha256) of every row of ``docs``.

    ``spans`` holds begin and end of the runs of words to remove, flat and in order: each word covered by ``length``
    consecutive words that also start in a row with a smaller ``key``. ``kept`` holds the remaining words, joined by one
    space, where something was removed, else it is null and all words stay; ``whole_sha256`` is the digest of all words
    joined by one space.

    Words are parted by ASCII white space only. A null ``key`` is neither smaller nor larger than any other, so its row
    loses nothing and takes nothing; rows that share a ``key`` do not take words from each other, but both lose what a
    smaller one holds. Null and empty texts and texts under ``length`` words lose nothing; exact copies of an earlier
    text of ``length`` words or more lose all; an empty table gives no rows; further columns, whatever their names, are
    never read. Texts of any length are read whole, one text being the least that a task holds.
    """
    docs = locatable(docs, "substrings-input")
    meta = docs.metadataColumn("_metadata")
    # a file is known by 64 bits of its path: files are few, and rows are numbered inside them
    docs = docs.select(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema["key"].dataType.simpleString()
    seeds = "seeds array<struct<anchor: long, one: long, two: long, low: int, high: int, at: int>>"
    rows = landed(docs.mapInArrow(partial(_seeds, length=length, seed=seed), f"file long, row long, key {kind}, n_words long, whole_sha256 string, {seeds}"), "substrings-rows")

    occurrence = rows.where("key IS NOT NULL").select("file", "row", "key", F.inline("seeds"))
    anchors = occurrence.groupBy("anchor").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("anchor")
    found = occurrence.withColumn("part", _part("row")).join(_dealt(landed(anchors, "substrings-anchors")), ["anchor", "part"]).drop("part")
    found = landed(found, "substrings-found")

    # distinct contexts, each with an occurrence in its earliest document
    lead = F.min(F.struct("key", "file", "row", "low", "high", "at")).alias("lead")
    contexts = landed(found.groupBy("anchor", "one", "two").agg(lead, F.max("key").alias("last")), "substrings-contexts")
    unlike = contexts.groupBy("anchor").agg(F.min("lead.key").alias("first"), F.max("lead.key").alias("other")).where("first < other").select("anchor")
    open_ = contexts.withColumn("part", _part("one")).join(_dealt(unlike), ["anchor", "part"])
    listed = open_.groupBy("lead.file", "lead.row").agg(F.collect_list(F.struct("one", "two", "lead.low", "lead.high", "lead.at")).alias("listed"))
    texts = docs.join(listed, ["file", "row"]).select("text", "key", "listed")
    windows = landed(texts.mapInArrow(partial(_extend, length=length), f"w1 long, w2 long, key {kind}, one long, two long, left int"), "substrings-windows")
    earliest = windows.groupBy("w1", "w2").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("w1", "w2", "first")
    later = windows.withColumn("part", _part("one", "left")).join(_dealt(earliest), ["w1", "w2", "part"]).where("key > first")
    lefts = later.groupBy("one", "two").agg(F.collect_set("left").alias("lefts"))

    answers = contexts.select("one", "two", F.col("lead.key").alias("earliest"), "last").join(lefts, ["one", "two"], "left")
    answers = landed(answers.where("last > earliest OR lefts IS NOT NULL"), "substrings-answers")
    hit = found.withColumn("part", _part("row", "at")).join(_dealt(answers), ["one", "two", "part"])
    whole = F.array(F.struct("low", "high"))
    some = F.transform("lefts", lambda left: F.struct((F.col("at") - left).alias("low"), (F.col("at") - left).alias("high")))
    starts = hit.select("file", "row", F.when(F.col("key") > F.col("earliest"), whole).otherwise(some).alias("starts")).where("starts IS NOT NULL")
    starts = starts.groupBy("file", "row").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    cut = docs.join(landed(starts, "substrings-starts"), ["file", "row"]).select("file", "row", "text", "starts")
    cut = landed(cut.mapInArrow(partial(_cut, length=length), "file long, row long, spans array<long>, kept string"), "substrings-cut")
    return (
        rows.drop("seeds")
        .join(cut, ["file", "row"], "left")
        .select(F.col("key").alias("doc_id"), "n_words", F.coalesce("spans", F.array().cast("array<long>")).alias("spans"), "kept", "whole_sha256")
    )


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    total = lambda odd: F.aggregate(F.filter(spans, lambda _, i: i % 2 == odd), F.lit(0).cast("long"), lambda a, b: a + b)
    return repeated_words(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", (total(1) - total(0)).alias("n_removed"), F.coalesce(F.sha2("kept", 256), "whole_sha256").alias("kept_sha256")
    )


_SQL = """
WITH texts AS (
    SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents
), worded AS (
    SELECT id, doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM texts
), placed AS (
    SELECT id, doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM worded
), runs AS (
    SELECT id, doc_id, x, i, count(*) OVER ahead AS n, string_agg(x, ' ') OVER ahead AS run
    FROM placed WINDOW ahead AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
), digests AS (
    SELECT id, doc_id, x, i, CASE WHEN n = 50 THEN sha256(run) END AS digest FROM runs
), firsts AS (
    SELECT digest, min(doc_id) AS first FROM digests WHERE digest IS NOT NULL GROUP BY digest
), hits AS (
    SELECT d.id, d.i, d.x, coalesce(f.first < d.doc_id, FALSE) AS hit FROM digests d LEFT JOIN firsts f USING (digest)
), covered AS (
    SELECT id, i, x, max(hit) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM hits
), kept AS (
    SELECT id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
        coalesce(string_agg(x, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept
    FROM covered GROUP BY id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (id)
"""

QUERIES = {"op13_substrings": op13_substrings}
SQL = {"op13_substrings": _SQL}
