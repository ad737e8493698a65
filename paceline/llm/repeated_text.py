"""Removal of repeated text by prefix-free parsing.

A rolling hash over 16 bytes triggers at the least of every 160 places, so equal text is cut in equal places whatever
surrounds it. The 400-byte strings that share their first trigger form a phrase: the bytes before the trigger from
which they start, and the text after it that they reach. A string can occur elsewhere only under a trigger with the
same text after it, so phrases are bucketed by the part of that text which all of their strings cover, and buckets of a
single occurrence are done with.

The distinct phrases of a bucket are its dictionary. A phrase that occurs twice as a whole is repeated in all of its
strings, one row for thousands of copies. For the rest, two suffix arrays combine into corpus order: one of the
dictionary's phrase beginnings (read backwards from the trigger), one of the parse (the text from the trigger on), each
with the common lengths of neighbours. For every distance r between start and trigger, strings are equal where both
arrays agree, over r bytes to the left and 400 - r to the right. No pair of strings is ever formed.

A bucket of very many distinct phrases is never gathered: its strings are counted by bucket, distance and fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import words
from paceline.llm.jaccard_join import groups_of
from paceline.llm.rows import landed, locatable, locator, table

# Fixed value of the contract: bytes of a string
LENGTH = 400
# Bytes under the rolling hash, and places of which the least one triggers
TRIGGER = 16
WINDOW = 160
# Text after the trigger that all strings of a phrase cover
COMMON = LENGTH - WINDOW + 1
# Phrases sorted together; larger buckets are split into their strings
TOGETHER = 20_000
SPLIT = 5_000
# Numbers shared by unlike texts up to which they are sent to all tasks
SENT = 200_000
PHRASE = "bucket long, phrase long, tid long, low int, at int, high int"


def _triggers(data: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """For each place the trigger of the window that begins there (the last WINDOW - 1 places have none)."""
    n = len(data) - TRIGGER + 1
    place = np.arange(n, dtype=np.uint64)
    key = words.span_prints(sums, place.astype(np.int64), place.astype(np.int64) + TRIGGER)
    # ties go to the first place
    key = (key >> np.uint64(32) << np.uint64(32)) | place
    padded = np.full(-(-n // WINDOW) * WINDOW, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    blocks = padded.reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - WINDOW + 1], ahead[WINDOW - 1 : n])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def phrases(data: np.ndarray, offsets: np.ndarray):
    """(text, low, trigger, high, bucket, phrase) of all phrases: strings start from low to high, places in ``data``."""
    size = np.diff(offsets)
    starts = np.where(size >= LENGTH, size - LENGTH + 1, 0)
    if not starts.sum():
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    sums = words.prefix_sums(data)
    text = np.repeat(np.arange(len(size)), starts)
    place = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts) + offsets[text]
    trigger = _triggers(data, sums)[place]
    fresh = np.ones(len(place), bool)
    fresh[1:] = (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(place)) - 1
    low, high, at = place[first], place[last], trigger[first]
    bucket = words.span_prints(sums, at, at + COMMON)
    phrase = words.mixed(words.span_prints(sums, low, high + LENGTH) + (at - low).astype(np.uint64) * words.BASE)
    return text[first], low, at, high, bucket, phrase


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tids = batch.column(1).to_numpy()
        for base, _, data, offsets in words.texts(batch.column(0), lower=False):
            text, low, at, high, bucket, phrase = phrases(data, offsets)
            begin = offsets[text]
            yield pa.record_batch(
                {
                    "bucket": bucket.view(np.int64),
                    "phrase": phrase.view(np.int64),
                    "tid": tids[base + text],
                    "low": (low - begin).astype(np.int32),
                    "at": (at - begin).astype(np.int32),
                    "high": (high - begin).astype(np.int32),
                }
            )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of listed phrases of buckets that are not split: (bucket, tid, at, left, right, least, most, single)."""
    for batch in batches:
        out: list[tuple] = []
        listed = batch.column(2).to_pylist()
        for base, high_row, data, offsets in words.texts(batch.column(0), lower=False):
            raw = data.tobytes()
            tids = batch.column(1).slice(base, high_row - base).to_pylist()
            for tid, rows, o in zip(tids, listed[base:high_row], offsets[:-1].tolist(), strict=True):
                for row in rows:
                    low, at, high = o + row["low"], o + row["at"], o + row["high"]
                    least, most = at - high, at - low
                    if not row["split"]:
                        out.append((row["bucket"], tid, row["at"], row["single"], raw[low:at], raw[at : high + LENGTH], least, most))
        names = ["bucket", "tid", "at", "single", "left", "right", "least", "most"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
        columns = zip(*out, strict=True) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, distance, print, tid, start, single): the strings of listed phrases of split buckets."""
    for batch in batches:
        listed = batch.column(2).to_pylist()
        for base, high_row, data, offsets in words.texts(batch.column(0), lower=False):
            tids = batch.column(1).slice(base, high_row - base).to_pylist()
            found = [
                (row["bucket"], tid, o, row["low"], row["at"], row["high"], row["single"])
                for tid, rows, o in zip(tids, listed[base:high_row], offsets[:-1].tolist(), strict=True)
                for row in rows
                if row["split"]
            ]
            if not found:
                continue
            bucket, tid, begin, low, at, high, single = (np.array(c) for c in zip(*found, strict=True))
            many = high - low + 1
            of = np.repeat(np.arange(len(found)), many)
            start = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            place = begin[of] + start
            prints = words.span_prints(words.prefix_sums(data), place, place + LENGTH)
            yield pa.record_batch(
                {
                    "bucket": bucket[of],
                    "distance": (at[of] - start).astype(np.int32),
                    "print": prints.view(np.int64),
                    "tid": tid[of],
                    "start": start.astype(np.int32),
                    "single": single[of],
                }
            )


def _suffix_array(group: np.ndarray, strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): strings sorted inside their group, and the common length of each with the one before."""
    size = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
    # a shorter string comes before one that it begins, also where text holds zero bytes
    key = np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), flat, size.astype(">u2").view(np.uint8).reshape(-1, 2)], axis=1)
    order = np.argsort(np.ascontiguousarray(key).view(f"V{key.shape[1]}").ravel(), kind="stable")
    ordered = flat[order]
    differ = np.ones((len(strings), width + 1), bool)
    differ[1:, :width] = ordered[1:] != ordered[:-1]
    common = differ.argmax(axis=1)
    common[1:] = np.minimum(common[1:], np.minimum(size[order][1:], size[order][:-1]))
    common[0] = -1
    common[1:][group[order][1:] != group[order][:-1]] = -1
    return order, common


def repeated_starts(group: np.ndarray, left: list[bytes], right: list[bytes], least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """(distance, phrase) flags: whether the string that starts so far before the trigger occurs in another phrase.

    ``left`` ends and ``right`` begins at the trigger; distances of a phrase run from ``least`` to ``most``.
    """
    n = len(group)
    by_left, left_common = _suffix_array(group, [s[::-1] for s in left], WINDOW)
    by_right, right_common = _suffix_array(group, right, LENGTH)
    found = np.zeros((WINDOW, n), bool)
    left_class, right_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for r in range(int(least.min()), int(most.max()) + 1):
        left_class[by_left] = np.cumsum(left_common < r)
        right_class[by_right] = np.cumsum(right_common < LENGTH - r)
        valid = np.flatnonzero((least <= r) & (r <= most))
        key = left_class[valid] * (n + 1) + right_class[valid]
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = key[order][1:] == key[order][:-1]
        found[r, valid[order[same[1:] | same[:-1]]]] = True
    return found


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, low, high): starts of repeated strings in phrases that occur once."""

    def solve(tables: list[pa.Table]) -> pa.RecordBatch:
        group = np.repeat(np.arange(len(tables)), [t.num_rows for t in tables])
        rows = pa.concat_tables(tables)
        least, most = rows["least"].to_numpy(), rows["most"].to_numpy()
        found = repeated_starts(group, rows["left"].to_pylist(), rows["right"].to_pylist(), least, most)
        found &= rows["single"].to_numpy(zero_copy_only=False)
        edge = np.zeros((WINDOW + 1, found.shape[1]), np.int8)
        edge[:-1] += found
        edge[1:] -= found
        phrase, near = np.nonzero(edge.T == 1)
        _, far = np.nonzero(edge.T == -1)
        at = rows["at"].to_numpy()[phrase]
        return pa.record_batch(
            {"tid": rows["tid"].to_numpy()[phrase], "low": (at - far + 1).astype(np.int32), "high": (at - near).astype(np.int32)}
        )

    waiting, n = [], 0
    for bucket in groups_of(batches, ["bucket"]):
        if bucket.num_rows > 1:
            waiting.append(bucket)
            n += bucket.num_rows
        if n >= TOGETHER:
            yield solve(waiting)
            waiting, n = [], 0
    if waiting:
        yield solve(waiting)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, spans, kept) of texts with their starts of repeated strings."""
    for batch in batches:
        spans, kept = [], []
        for text, starts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = np.frombuffer(text.encode(), np.uint8)
            cover = np.zeros(len(raw) + 1, np.int64)
            np.add.at(cover, [s["low"] for s in starts], 1)
            np.add.at(cover, [s["high"] + LENGTH for s in starts], -1)
            gone = np.cumsum(cover)[:-1] > 0
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            spans.append(np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).ravel().tolist())
            kept.append(raw[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], ["tid", "spans", "kept"])


def _identified(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs`` with a number ``tid`` of the text, its rows without text, and (tid, at, copies) of the texts.

    The number is a hash of ``bits`` bits. Texts that share it are told apart by SHA-256 and numbered anew.
    """
    whole = F.sha2("text", 256)
    docs = docs.withColumn("tid", F.shiftrightunsigned(F.xxhash64("text", F.octet_length("text")), 64 - bits))
    rows = landed(docs.select("at", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "tid", whole.alias("whole_sha256")), "repeats-rows")
    texts, unlike = _texts(rows)
    n = unlike.count()
    if n:
        unlike = unlike.withColumn("unlike", F.lit(True))
        unlike = F.broadcast(unlike) if n <= SENT else unlike

        def anew(df, digest):
            tid = F.when(F.col("unlike"), F.xxhash64(F.lit("unlike"), digest)).otherwise(F.col("tid"))
            return df.join(unlike, "tid", "left").withColumn("tid", tid).drop("unlike")

        docs, rows = anew(docs, whole), landed(anew(rows, F.col("whole_sha256")), "repeats-rows")
        texts, unlike = _texts(rows)
        if unlike.count():
            raise RuntimeError("unlike texts share a number twice")
    return docs, rows, texts


def _texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts by number, numbers that unlike texts share)."""
    digests = [F.min("whole_sha256").alias("one"), F.max("whole_sha256").alias("two")]
    texts = landed(rows.groupBy("tid").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("copies"), *digests), "repeats-numbers")
    return texts.drop("one", "two"), texts.where("one <> two").select("tid")


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", split: int = SPLIT, id_bits: int = 64) -> DataFrame:
    """(at, doc_id, n_bytes, spans, kept, whole_sha256) of every row of ``docs``.

    ``spans`` holds begin and end of the byte runs to remove, flat and in order: every byte covered by a 400-byte string
    that also starts anywhere else in the corpus, overlaps and the same row included. ``kept`` holds the remaining bytes
    where something was removed, else it is null and the whole text stays. Texts are bytes in UTF-8, so a cut may split
    a character. Null and empty texts and texts under 400 bytes lose nothing; repeated rows and copies of 400 bytes or
    more are removed whole; an empty table gives no rows; only the two named columns are read. Texts are told apart by
    SHA-256 wherever their numbers of ``id_bits`` bits agree. Phrases that occur as a whole and the strings of a bucket of
    more than ``split`` phrases are known by two 64-bit fingerprints, that of the bucket and their own; all else is
    compared byte by byte.
    """
    docs = locatable(docs, "repeats-input")
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = docs.select(content.alias("text"), locator(docs).alias("at"), F.col(f"`{key}`").alias("doc_id"))
    docs, rows, texts = _identified(docs, id_bits)

    parsed = docs.select("text", "tid").mapInArrow(_parse, PHRASE)
    occurrence = F.xxhash64("tid", "at")
    buckets = parsed.groupBy("bucket").agg(F.min(occurrence).alias("one"), F.max(occurrence).alias("two")).where("one <> two").select("bucket")
    found = landed(parsed.join(landed(buckets, "repeats-buckets"), "bucket").distinct(), "repeats-phrases")

    entry = F.struct("tid", "low", F.col("at").alias("place"), "high")
    dictionary = landed(found.groupBy("bucket", "phrase").agg(F.count(F.lit(1)).alias("n"), F.min(entry).alias("entry")), "repeats-dictionary")
    whole = found.join(dictionary.where("n > 1").select("bucket", "phrase"), ["bucket", "phrase"], "left_semi").select("tid", "low", "high")
    open_ = dictionary.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("singles")).where("kinds > 1 AND singles > 0")
    listed = dictionary.join(open_, "bucket").select(
        "entry.tid",
        F.struct(
            "bucket", "entry.low", F.col("entry.place").alias("at"), "entry.high", (F.col("n") == 1).alias("single"), (F.col("kinds") > split).alias("split")
        ).alias("phrase"),
    )
    listed = listed.groupBy("tid").agg(F.collect_list("phrase").alias("phrases"))

    # one copy of every text that shares a bucket
    active = found.select("tid").distinct().join(texts, "tid").join(listed, "tid", "left").withColumnRenamed("at", "place")
    places = docs.select("text", "at")
    active = landed(places.join(active, F.col("at") == F.col("place")).select("text", "tid", "phrases"), "repeats-texts")
    contexts = active.where("phrases IS NOT NULL").mapInArrow(
        _contexts, "bucket long, tid long, at int, single boolean, left binary, right binary, least int, most int"
    )
    resolved = contexts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_resolve, "tid long, low int, high int")
    # a bucket of any size is only counted here
    strings = active.where(F.exists("phrases", lambda p: p["split"])).mapInArrow(
        _strings, "bucket long, distance int, print long, tid long, start int, single boolean"
    )
    strings, same = landed(strings, "repeats-strings"), ["bucket", "distance", "print"]
    twice = strings.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*same)
    counted = strings.where("single").join(twice, same, "left_semi").select("tid", F.col("start").alias("low"), F.col("start").alias("high"))
    starts = landed(whole.unionByName(resolved).unionByName(counted), "repeats-starts").groupBy("tid").agg(F.collect_list(F.struct("low", "high")).alias("starts"))
    cut = active.join(starts, "tid").select("text", "tid", "starts").mapInArrow(_cut, "tid long, spans array<long>, kept binary")
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    none = F.array().cast("array<long>")
    return (
        rows.join(texts.select("tid", "copies"), "tid")
        .join(landed(cut, "repeats-cut"), "tid", "left")
        .select(
            "at",
            "doc_id",
            "n_bytes",
            F.when(copied, F.array(F.lit(0).cast("long"), "n_bytes")).otherwise(F.coalesce("spans", none)).alias("spans"),
            F.when(copied, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
            "whole_sha256",
        )
    )


def op6_repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    begin = F.filter(spans, lambda _, i: i % 2 == 0)
    end = F.filter(spans, lambda _, i: i % 2 == 1)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    return repeated_spans(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (total(end) - total(begin)).alias("n_removed"),
        (F.size(spans) / 2).cast("long").alias("n_spans"),
        F.coalesce(F.sha2("kept", 256), "whole_sha256").alias("kept_sha256"),
    )


QUERIES = {"op6_repeated_text": op6_repeated_text}
SQL: dict[str, str] = {}
