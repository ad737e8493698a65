"""Phrase mining by prefix-free parsing.

Every text becomes a row of words with marks where a piece ends. A place where the fingerprint of three words is the
least among its neighbours starts a new chunk, so equal text is cut in equal places whatever surrounds it. A chunk also
holds the few words after its end that phrases from inside it reach, behind a tab: a phrase belongs to the chunk in
which it starts, so overlaps count once. The distinct chunks are the dictionary, each with its frequency in the parse;
copies of a text add to frequencies only.

Phrases are counted inside distinct chunks, weighted, one length after the other. A phrase can only be frequent if both
phrases that are a word shorter are, so longer ones pass a bitmap of frequent shorter ones first; false hits of the
bitmap add rows that the exact count drops. All counts are by the phrase itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from paceline.llm import words
from paceline.llm.rows import landed, shared, table, text_of

# Fixed values of the contract: words of a phrase, its least frequency, hundredths a longer one takes, and the list's length
MOST = 3
LEAST = 10
SHARE = 50
TOP = 2000
PIECE_MARKS = b".,;:!?\x0a\x0b\x0c\x0d"
# Words to each side among which a trigger is the least, words of its fingerprint, and the longest core of a chunk
REACH = 12
CONTEXT = 3
LONGEST = 96
# Bits of the bitmap of frequent phrases, and bytes of chunks that are counted together
FILTER_BITS = 1 << 25
TOGETHER = 4 << 20
# Parts in which the candidates of one group are ranked
PARTS = 64

_MARK = np.zeros(256, bool)
_MARK[list(PIECE_MARKS)] = True
_WORD = ~_MARK
_WORD[[9, 32]] = False
_CHUNK_WORD = np.ones(256, bool)
_CHUNK_WORD[[9, 10, 32]] = False


def triggers(prints: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places whose fingerprint of CONTEXT words is less than all REACH before, and no more than all REACH after."""
    n = len(prints)
    key = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    grams = words.gram_prints(prints, CONTEXT)
    key[: len(grams)] = grams
    ends = np.repeat(bounds[1:], np.diff(bounds))
    begins = np.repeat(bounds[:-1], np.diff(bounds))
    at = np.flatnonzero(np.arange(n) + CONTEXT <= ends)
    for step in range(1, REACH + 1):
        before, after = at - step, at + step
        fine = (before < begins[at]) | (key[at] < key[np.maximum(before, 0)])
        # the last places of a text have fewer words than a fingerprint, so they never decide
        fine &= (after + CONTEXT > ends[at]) | (key[at] <= key[np.minimum(after, n - 1)])
        at = at[fine]
    return at


def _gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the byte spans one after the other."""
    offsets = np.append(0, np.cumsum(lengths))
    return data[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])], offsets


def chunks(data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """(text, chunk, words of its core) of all chunks.

    Words of a chunk are parted by spaces, pieces by line feeds; words beyond the core follow a tab.
    """
    starts, ends, bounds = words.spans(data, offsets, _WORD)
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64)
    prints = words.word_prints(data, starts, ends)
    marks = np.append(0, np.cumsum(_MARK[data]))
    fresh = np.ones(n + 1, bool)
    fresh[1:n] = marks[starts[1:]] > marks[ends[:-1]]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    fresh[heads] = True

    first = np.union1d(heads, triggers(prints, bounds))
    size = np.diff(np.append(first, n))
    parts = -(-size // LONGEST)
    first = np.repeat(first, parts) + LONGEST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    last = np.append(first[1:], n)
    beyond, open_ = np.zeros(len(first), np.int64), np.ones(len(first), bool)
    for step in range(most - 1):
        open_ = open_ & ~fresh[np.minimum(last + step, n)]
        beyond += open_

    held = last - first + beyond
    begin = np.append(0, np.cumsum(held))
    word = np.repeat(first - begin[:-1], held) + np.arange(begin[-1])
    # each word with the byte after it, which its mark replaces
    body, where = _gather(np.append(data, np.uint8(10)), starts[word], ends[word] - starts[word] + 1)
    body[where[1:] - 1] = np.where(fresh[word + 1], 10, 32)
    tail = begin[:-1] + (last - first) - 1
    body[where[tail[beyond > 0] + 1] - 1] = 9
    body[where[begin[1:]] - 1] = 10
    chunk = pa.StringArray.from_buffers(len(first), pa.py_buffer(where[begin].astype(np.int32)), pa.py_buffer(body))
    return words.owners(bounds)[first], chunk, last - first


def _parse(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        group = batch.column(0)
        for base, _, data, offsets in words.texts(batch.column(1)):
            text, chunk, size = chunks(data, offsets, most)
            yield pa.RecordBatch.from_arrays([group.take(pa.array(base + text)), chunk, pa.array(size)], ["group", "chunk", "words"])


def _group_prints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) codes of a text column and the fingerprint of each row's value."""
    coded = column.dictionary_encode()
    codes = coded.indices.to_numpy()
    raw = [value.encode() for value in coded.dictionary.to_pylist()]
    places = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    prints = words.word_prints(np.frombuffer(b"".join(raw), np.uint8), places[:-1], places[1:])
    return codes, words.mixed(prints + words.BASE)[codes] if len(raw) else np.zeros(0, np.uint64)


def _slots(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (prints & mask).astype(np.int64), (prints >> np.uint64(32) & mask).astype(np.int64)


def _bits(batches: Iterator[pa.RecordBatch], size: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(place, bits): the bitmap's non-zero words for phrases of ``size`` words."""
    held = np.zeros(bits // 64, np.uint64)
    for batch in batches:
        _, group = _group_prints(batch.column(0))
        for low, high, data, offsets in words.texts(batch.column(1), lower=False):
            starts, ends, _ = words.spans(data, offsets, _CHUNK_WORD)
            prints = words.gram_prints(words.word_prints(data, starts, ends), size)[::size]
            for slot in _slots(words.mixed(prints ^ group[low:high]), bits):
                np.bitwise_or.at(held, slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64))
    place = np.flatnonzero(held)
    yield pa.record_batch({"place": place, "bits": held[place].view(np.int64)})


def bitmap(spark: SparkSession, frequent: DataFrame, size: int, bits: int):
    """Bitmap of the phrases (group, phrase), of fixed size, on every executor."""
    found = frequent.select("group", "phrase").mapInArrow(partial(_bits, size=size, bits=bits), "place long, bits long")
    found = found.groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    held = np.zeros(bits // 64, np.uint64)
    held[found["place"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return shared(spark, held)


def _passes(held: np.ndarray, prints: np.ndarray) -> np.ndarray:
    fine = np.ones(len(prints), bool)
    for slot in _slots(prints, len(held) * 64):
        fine &= (held[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return fine


def _grams(batches: Iterator[pa.RecordBatch], size: int, frequent) -> Iterator[pa.RecordBatch]:
    """(group, phrase, n): phrases of ``size`` words that start in the cores of chunks, summed over many chunks."""

    def count(waiting: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(waiting).group_by(["group", "phrase"], use_threads=False).aggregate([("n", "sum")])
        rows = rows.combine_chunks().rename_columns(["group", "phrase", "n"])
        return pa.RecordBatch.from_arrays([rows[c].combine_chunks() for c in ("group", "phrase", "n")], ["group", "phrase", "n"])

    held = frequent() if frequent else None
    waiting, waits = [], 0
    for batch in batches:
        _, group = _group_prints(batch.column(0))
        weight = batch.column(2).to_numpy()
        for low, high, data, offsets in words.texts(batch.column(1), lower=False):
            starts, ends, bounds = words.spans(data, offsets, _CHUNK_WORD)
            row = words.owners(bounds)
            tabs = np.append(0, np.cumsum(data == 9))
            fine = tabs[starts] == tabs[offsets[:-1]][row]
            linked = data[ends] != 10
            n = max(0, len(starts) - size + 1)
            fine = fine[:n]
            for step in range(size - 1):
                fine = fine & linked[step : step + n]
            at = np.flatnonzero(fine)
            if held is not None:
                less = words.gram_prints(words.word_prints(data, starts, ends), size - 1)
                key = group[low:high][row]
                for step in range(2):
                    at = at[_passes(held, words.mixed(less[at + step] ^ key[at + step]))]
            plain = np.where(data == 9, np.uint8(32), data)
            body, where = _gather(plain, starts[at], ends[at + size - 1] - starts[at])
            phrase = pa.StringArray.from_buffers(len(at), pa.py_buffer(where.astype(np.int32)), pa.py_buffer(body))
            of = low + row[at]
            waiting.append(pa.table({"group": batch.column(0).take(pa.array(of)), "phrase": phrase, "n": weight[of]}))
            waits += len(data)
            if waits >= TOGETHER:
                yield count(waiting)
                waiting, waits = [], 0
    if waiting:
        yield count(waiting)


def dictionary_of(docs: DataFrame, text: str = "text", group: str = "lang", most: int = MOST) -> DataFrame:
    """(group, chunk, words, n): the distinct chunks of all texts, words of their cores, and how often each occurs."""
    rows = docs.select(F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("und")).alias("group"), text_of(text).alias("text"))
    parsed = rows.mapInArrow(partial(_parse, most=most), "group string, chunk string, words long")
    return landed(parsed.groupBy("group", "chunk", "words").agg(F.count(F.lit(1)).alias("n")), "phrase-dictionary")


def frequencies(dictionary: DataFrame, most: int = MOST, least: int = LEAST, bits: int = FILTER_BITS) -> list[DataFrame]:
    """(group, phrase, f) of the phrases of 1, 2, ... ``most`` words that occur ``least`` times or more."""
    spark, out = dictionary.sparkSession, []
    for size in range(1, most + 1):
        shorter = bitmap(spark, out[-1], size - 1, bits) if out else None
        rows = dictionary.select("group", "chunk", "n").mapInArrow(partial(_grams, size=size, frequent=shorter), "group string, phrase string, n long")
        out.append(landed(rows.groupBy("group", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least), f"phrases-{size}"))
    return out


def _joined(words_: F.Column, begin, length) -> F.Column:
    return F.array_join(F.slice(words_, begin, length), " ")


def collocations(
    docs: DataFrame,
    text: str = "text",
    group: str = "lang",
    most: int = MOST,
    least: int = LEAST,
    share: int = SHARE,
    top: int = TOP,
    bits: int = FILTER_BITS,
) -> DataFrame:
    """(group, rank, phrase, a, l, r, n, score): the best phrases of 2 to ``most`` words of each group.

    ``a``, ``l`` and ``r`` are the frequencies of the phrase and of the two parts of its weakest cut, ``n`` all words of
    the group, ``score`` the whole part of 10^6 a^2 / (l r). Phrases inside a longer one that has at least ``share``
    hundredths of their frequency are left out. Equal scores go by frequency, then by the phrase's bytes, so ranks are
    the same on every run.

    A null ``group`` is ``und``. Null and empty texts have no words; texts of any length are cut into chunks of at most
    LONGEST words; repeated rows count as often as they occur; an empty table gives no rows; further columns, whatever
    their names, are never read. Products are decimals of 38 digits, exact for frequencies up to 10^15.
    """
    dictionary = dictionary_of(docs, text, group, most)
    totals = dictionary.groupBy("group").agg(F.sum(F.col("words") * F.col("n")).alias("n"))
    found = frequencies(dictionary, most, least, bits)
    known = found[0]
    for level in found[1:]:
        known = known.unionByName(level)
    candidates = found[1]
    for level in found[2:]:
        candidates = candidates.unionByName(level)
    candidates = candidates.withColumnRenamed("f", "a").withColumn("words", F.split("phrase", " "))

    # both parts of every cut meet their frequency in one join
    size, w = F.size("words"), F.col("words")
    cuts = F.transform(
        F.sequence(F.lit(1), size - 1),
        lambda k: F.array(
            F.struct(k.alias("k"), F.lit(True).alias("is_first"), _joined(w, 1, k).alias("part")),
            F.struct(k.alias("k"), F.lit(False).alias("is_first"), _joined(w, k + 1, size - k).alias("part")),
        ),
    )
    parts = candidates.select("group", "phrase", "a", F.inline(F.flatten(cuts)))
    parts = parts.join(known.withColumnRenamed("phrase", "part"), ["group", "part"])
    sides = parts.groupBy("group", "phrase", "a", "k").agg(F.max(F.when(F.col("is_first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("is_first"), F.col("f"))).alias("r"))
    wide = T.DecimalType(19, 0)
    score = F.expr("(CAST(1000000 AS DECIMAL(7,0)) * wide * wide) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    sides = sides.withColumn("wide", F.col("a").cast(wide)).withColumn("score", score)
    scored = sides.groupBy("group", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # phrases inside a longer candidate
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: _joined(w, i, m))))
    longer = candidates.where(size > 2).select("group", F.explode(inner).alias("phrase"), "a")
    longer = longer.groupBy("group", "phrase").agg(F.max("a").alias("above"))
    kept = scored.join(longer, ["group", "phrase"], "left").where(F.col("above").isNull() | (100 * F.col("above") < share * F.col("a")))

    kept = kept.select("group", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part"))
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("group", "part").orderBy(*best))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(*best))).where(F.col("rank") <= top)
    return kept.join(totals, "group").select("group", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).withColumnRenamed("group", "lang")


_SQL = """
WITH pieces AS (
    SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM (
        SELECT coalesce(lang, 'und') AS lang,
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
        FROM documents
    )
), pieced AS (
    SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), placed AS (
    SELECT lang, id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM pieced
), runs AS (
    SELECT lang, x, lead(x, 1) OVER (PARTITION BY id ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY id ORDER BY i) AS z FROM placed
), grams AS (
    SELECT lang, 1 AS m, x AS phrase FROM runs
    UNION ALL SELECT lang, 2, x || ' ' || y FROM runs WHERE y IS NOT NULL
    UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z FROM runs WHERE z IS NOT NULL
), counted AS (
    SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE m = 1 GROUP BY lang
), candidates AS (
    SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE m > 1 AND f >= 10
), cuts AS (
    SELECT lang, phrase, a, w, k.k AS k,
        array_to_string(list_slice(w, 1, k.k), ' ') AS part, array_to_string(list_slice(w, k.k + 1, m), ' ') AS rest
    FROM candidates, (VALUES (1), (2)) AS k(k) WHERE k.k < m
), scored AS (
    SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r,
        ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.part JOIN counted y ON y.lang = c.lang AND y.phrase = c.rest
), weakest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT lang, phrase, max(a) AS above FROM (
        SELECT lang, array_to_string(list_slice(w, 1, 2), ' ') AS phrase, a FROM candidates WHERE m = 3
        UNION ALL SELECT lang, array_to_string(list_slice(w, 2, 3), ' '), a FROM candidates WHERE m = 3
    ) GROUP BY ALL
), kept AS (
    SELECT w.* FROM weakest w LEFT JOIN inside i USING (lang, phrase) WHERE above IS NULL OR 100 * above < 50 * a
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

QUERIES = {"op11_collocations": op11_collocations}
SQL = {"op11_collocations": _SQL}
