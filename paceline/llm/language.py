"""Language identification by prediction by partial matching.

Each language has a byte context tree of order three. Its statistics are frozen after training; a byte that a context
has not seen is reached by an escape, whose probability is the share of distinct successors (method C), and the next
shorter context then excludes what the longer one has seen. Every byte of a text therefore has an exact code length
under every language, and the language with the shortest code wins.

The trees are laid out as one table of code lengths per (context, byte), so scoring is two look-ups per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import words
from paceline.llm.rows import shared, table

ORDER = 3
FOLDS = 5


# Bytes of text that are scored together: a worker holds some tens of times as much
PIECE = 1 << 18


def training_row(key: Column) -> Column:
    """Rows that may be learnt from: CRC-32 of the id as text is no multiple of five."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % FOLDS != 0


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case for the two-byte Latin letters too (ASCII is lower-cased before)."""
    out = data.copy()
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    capital = after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    out[capital] += 0x20
    return out


def _windows(symbols: np.ndarray, offsets: np.ndarray, padding: int) -> list[np.ndarray]:
    """For each byte the ORDER symbols before it, oldest first; texts begin after padding."""
    since = np.arange(len(symbols)) - np.repeat(offsets[:-1], np.diff(offsets))
    before = []
    for back in range(ORDER, 0, -1):
        shifted = np.full(len(symbols), padding, symbols.dtype)
        shifted[back:] = symbols[: len(symbols) - back]
        shifted[since < back] = padding
        before.append(shifted)
    return before


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (context, byte) of each language: four bytes packed in a number."""
    for batch in batches:
        languages = np.array(batch.column(1).to_pylist(), object)
        for low, high, data, offsets in words.texts(batch.column(0), piece=PIECE):
            before = _windows(_folded(data).astype(np.int64), offsets, 0)
            gram = before[0] << 24 | before[1] << 16 | before[2] << 8 | _folded(data)
            name = np.repeat(languages[low:high], np.diff(offsets))
            for language in set(languages[low:high]):
                grams, n = np.unique(gram[name == language], return_counts=True)
                yield pa.record_batch({"lang": [language] * len(grams), "gram": grams, "n": n})


@dataclass
class Trees:
    """Frozen context trees: symbol of each byte, row of each context, code lengths in bits."""

    languages: list[str]
    symbol: np.ndarray = field(default=None)
    context: np.ndarray = field(default=None)
    bits: np.ndarray = field(default=None)

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of every text under every language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(data) or not self.languages:
            return out
        symbols = self.symbol[_folded(data)]
        size = len(self.bits[0])
        a, b, c = _windows(symbols, offsets, 0)
        rows = self.context[(a * size + b) * size + c]
        filled = np.flatnonzero(np.diff(offsets))
        out[filled] = np.add.reduceat(self.bits[rows, symbols], offsets[filled], axis=0, dtype=np.float64)
        return out


def _probabilities(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Successor probabilities of contexts (rows) from their counts and those of the next shorter contexts."""
    seen = counts > 0
    total, kinds = counts.sum(1, keepdims=True), seen.sum(1, keepdims=True)
    scale = np.maximum(total + kinds, 1)
    left = 1 - np.where(seen, shorter, 0).sum(1, keepdims=True)
    escape = np.where(total > 0, kinds / scale, 1.0)
    # a context that has seen every byte has nothing to escape to
    full = left <= 1e-12
    found = np.where(full, counts / np.maximum(total, 1), counts / scale)
    return np.where(seen, found, np.where(full, 1e-12, escape * shorter / np.where(full, 1, left)))


def build_trees(rows: list[tuple[str, int, int]] | pa.Table) -> Trees:
    """Trees from (language, packed context and byte, count)."""
    if not isinstance(rows, pa.Table):
        rows = pa.table(dict(zip(("lang", "gram", "n"), zip(*rows, strict=True), strict=True))) if rows else pa.table({"lang": []})
    names = rows["lang"].combine_chunks().dictionary_encode()
    found = names.dictionary.to_pylist()
    trees = Trees(sorted(found))
    if not found:
        return trees
    gram = rows["gram"].to_numpy().astype(np.int64)
    n = rows["n"].to_numpy().astype(np.float64)
    language = np.array([trees.languages.index(x) for x in found])[names.indices.to_numpy()]
    known = np.unique(np.concatenate([gram >> s & 255 for s in (24, 16, 8, 0)] + [[0]]))
    # symbol 0 is the padding, the last one any byte that training never saw
    trees.symbol = np.full(256, len(known), np.int32)
    trees.symbol[known] = np.arange(len(known))
    size = len(known) + 1
    a, b, c, d = (trees.symbol[gram >> s & 255].astype(np.int64) for s in (24, 16, 8, 0))
    deep = (a * size + b) * size + c
    contexts = np.unique(deep)
    trees.context = np.tile(len(contexts) + np.arange(size * size, dtype=np.int32), size)
    trees.context[contexts] = np.arange(len(contexts))
    trees.bits = np.zeros((len(contexts) + size * size, size, len(trees.languages)), np.float32)
    base = np.full((1, size), 1 / 256)
    base[0, -1] = (257 - size) / 256  # all unseen bytes together
    for i in range(len(trees.languages)):
        own = language == i
        level = base
        for keys, rows_of in ((np.zeros(len(gram), np.int64), np.zeros(1, np.int64)), (c, np.arange(size)), (b * size + c, np.arange(size * size)), (deep, contexts)):
            counts = np.zeros((len(rows_of), size))
            np.add.at(counts, (np.searchsorted(rows_of, keys[own]), d[own]), n[own])
            parent = rows_of % max(1, len(level)) if len(level) > 1 else np.zeros(len(rows_of), np.int64)
            level, previous = _probabilities(counts, level[parent]), level
        for low, part in ((0, level), (len(contexts), previous)):
            bits = -np.log2(part)
            bits[:, -1] += np.log2(max(1, 257 - size))
            trees.bits[low : low + len(part), :, i] = bits
    return trees


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_bytes: int = 8_000_000) -> Trees:
    """Context trees of all languages of the training rows of ``docs``.

    The trees are fitted on whole texts of a sample of labelled rows, about ``sample_bytes`` of text per language
    chosen by a seeded hash (all of a language that has less); sizes are counted over all rows.
    """
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{key}`").alias("key"))
    rows = rows.where(training_row(F.col("key")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size"))
    # one row per language, as the trees themselves
    span, shares = 1 << 30, {}
    for name, size in sizes.collect():
        shares[name] = int((1 << 30) * min(1.0, sample_bytes / max(size, 1)))
    if not shares:
        return build_trees([])
    limit = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("trees"), "key"), F.lit(span)) < limit)
    counted = chosen.select("text", "lang").mapInArrow(_count_grams, "lang string, gram long, n long")
    # some hundred thousand counts, which weigh a multiple as rows
    return build_trees(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow())


def _scorer(frozen):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: Trees = frozen()
        for batch in batches:
            names, scores, per_byte = [], np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for low, high, data, offsets in words.texts(batch.column(0), piece=PIECE):
                bits = trees.code_lengths(data, offsets)
                if not trees.languages:
                    names += [None] * len(bits)
                    continue
                best = bits.argmin(1)
                least = bits[np.arange(len(bits)), best]
                names += [trees.languages[i] for i in best]
                scores[low:high] = 1 / np.exp2(least[:, None] - bits).sum(1)
                per_byte[low:high] = least / np.maximum(np.diff(offsets), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores), pa.array(per_byte), batch.column(1)],
                ["lang_pred", "score", "bits_per_byte", "record"],
            )

    return score


def identify(docs: DataFrame, trees: Trees, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(lang_pred, score, bits_per_byte, record) of every whole text of ``docs``.

    ``score`` is the probability of the predicted language among the learnt ones, all taken as equally likely before
    the text is seen; ``bits_per_byte`` the code length of the text under it. A null text, a text without any letter
    and every text where no language was learnt are ``und`` with score 0. Ties go to the first language by name.
    ``record`` holds the columns ``carry`` (default all), so names cannot clash; repeated rows get equal results.
    """
    record = F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)])
    letters = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    # a text without letters is not scored at all
    rows = docs.select(F.when(letters, F.col(f"`{text}`")).alias("text"), F.struct(letters.alias("letters"), record.alias("row")).alias("record"))
    kind = rows.schema["record"].dataType.simpleString()
    found = rows.mapInArrow(_scorer(shared(docs.sparkSession, trees)), f"lang_pred string, score double, bits_per_byte double, record {kind}")
    known = F.col("record.letters") & F.col("lang_pred").isNotNull()
    return found.select(
        F.when(known, F.col("lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(known, F.col("score")).otherwise(0.0).alias("score"),
        F.when(known, F.col("bits_per_byte")).alias("bits_per_byte"),
        F.col("record.row").alias("record"),
    )


def recognised_rows(docs: DataFrame, most_bits: float = 8.0) -> DataFrame:
    """Rows whose text is in a learnt language: not ``und``, and coded in fewer bits than its bytes have."""
    found = identify(docs, train(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") < most_bits)).select("record.*")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs), carry=["doc_id"]).select(
        F.col("record.doc_id").alias("doc_id"), (~training_row(F.col("record.doc_id"))).alias("held_out"), "lang_pred", "score"
    )


QUERIES = {"op4_language": op4_language}
SQL: dict[str, str] = {}
