"""Exact Jaccard join of documents on word shingles, as groups of linked documents.

Equal sets are folded first. A set's shingles are put in one order for the whole corpus, rare ones first, and the
prefix filter says that two different sets with a Jaccard coefficient of at least j share m of the first
n - ceil(j n) + m shingles of each (m is three from j = 2/3, see ``needed``), so a set that shares fewer with all others
together is done with. The place of such a shingle bounds the sizes of the sets that it can link. Tiles hold the sets
that share one. Inside a tile, sets are ordered by size, sizes bound who can meet whom, and hashed bitmap signatures
bound the overlap from above: the bits of one set that the other lacks are shingles that it lacks. What passes is
decided on the sorted arrays of shingles.

Groups are wanted, so a tile only looks for links that join two groups. Two rounds over the tiles of every set's most
shared prefix shingles settle families of near copies; a last round takes all prefix shingles, in tiles by
(shingle, size band) and only between sets that are still in different groups, so no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import words
from paceline.llm.components import components
from paceline.llm.rows import landed, locatable, locator, release, shared, table

# Contract of op8: words of a shingle, and the coefficient in hundredths
SHINGLE = 3
LEVEL = 90
# Buckets of the counts that order shingles by rarity (words, shingles); their noise only costs time
WORD_BUCKETS = 1 << 16
GRAM_BUCKETS = 1 << 20
# Rounds before the last, and sets taken together in a tile
ROUNDS = 2
TILE = 1000
# Bytes of text that a scan turns into shingles together
PIECE = 1 << 18
# Pairs and rows looked at together, and count above the average from which a shingle's bucket is reported
PAIRS = 400_000
ROWS = 16_000
MARGIN = 16


def needed(level: int) -> int:
    """Prefix shingles that different linked sets have in common at the least.

    The union of linked sets that differ has a shingle beyond their overlap, which is thus level / (100 - level) or more.
    More than three are not asked for, because each makes prefixes longer.
    """
    return 3 if level >= 100 else min(3, -(-level // (100 - level)))


def linked(common, n_a, n_b, level=LEVEL):
    """Whether sets of these sizes with so many common shingles are linked."""
    return (100 + level) * common >= level * (n_a + n_b)


def _shingles(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(text, shingle, buckets of its words) of every shingle, one per place."""
    starts, ends, bounds = words.spans(data, offsets, words.NOT_SPACE)
    prints = words.word_prints(data, starts, ends)
    n = np.diff(bounds)
    grams = words.gram_prints(prints, shingle)
    doc = words.owners(bounds)
    bucket = (prints % np.uint64(WORD_BUCKETS)).astype(np.uint16)
    at = np.flatnonzero(doc[: len(grams)] == doc[shingle - 1 :]) if len(grams) else np.zeros(0, np.int64)
    text, gram = doc[at], grams[at]
    trio = [bucket[at + i] for i in range(shingle)]
    # texts of fewer words are one shingle as a whole
    for size in range(1, shingle):
        few = np.flatnonzero(n == size)
        if len(few):
            own = words.gram_prints(prints, size)[bounds[few]] + np.uint64(size)
            text, gram = np.append(text, few), np.append(gram, own)
            trio = [np.append(w, bucket[bounds[few] + min(i, size - 1)]) for i, w in enumerate(trio)]
    return text, gram, trio


def _sets(data: np.ndarray, offsets: np.ndarray, shingle: int):
    """(bounds, shingles, their words): distinct shingles of each text, ascending."""
    text, gram, trio = _shingles(data, offsets, shingle)
    order = np.argsort(gram)
    order = order[np.argsort(text[order], kind="stable")]
    text, gram = text[order], gram[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
    text, gram = text[fresh], gram[fresh]
    return np.searchsorted(text, np.arange(len(offsets))), gram, [w[order[fresh]] for w in trio]


def _describe(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Set id (null without shingles) and size of every text."""
    for batch in batches:
        n, sid = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
        for low, high, data, offsets in words.texts(batch.column(0), piece=PIECE):
            bounds, gram, _ = _sets(data, offsets, shingle)
            n[low:high] = np.diff(bounds)
            sums = np.append(np.uint64(0), np.cumsum(words.mixed(gram ^ words.BASE)))
            sid[low:high] = words.mixed((sums[bounds[1:]] - sums[bounds[:-1]]) + n[low:high].astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(sid.view(np.int64), mask=n == 0), pa.array(n), batch.column(1)], ["sid", "n", "row"])


def _count(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Counts per bucket of words (kind 0) and of shingles well above the average bucket (kind 1)."""
    totals = [np.zeros(WORD_BUCKETS, np.int64), np.zeros(GRAM_BUCKETS, np.int64)]
    for batch in batches:
        for _, _, data, offsets in words.texts(batch.column(0), piece=PIECE):
            _, gram, trio = _sets(data, offsets, shingle)
            totals[0] += np.bincount(trio[0], minlength=WORD_BUCKETS)
            totals[1] += np.bincount((gram % np.uint64(GRAM_BUCKETS)).astype(np.int64), minlength=GRAM_BUCKETS)
    for kind, total in enumerate(totals):
        some = np.flatnonzero(total > kind * (MARGIN + 4 * total.mean()))
        yield pa.record_batch({"kind": np.full(len(some), kind, np.int32), "bucket": some, "n": total[some]})


def _rarity(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Size classes of word and shingle buckets: two arrays of fixed length."""
    out = (np.zeros(WORD_BUCKETS, np.uint8), np.zeros(GRAM_BUCKETS, np.uint8))
    counted = docs.select("text").mapInArrow(partial(_count, shingle=shingle), "kind int, bucket long, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    # one job for all parts; a row per bucket at most
    found = counted.toArrow()
    kinds, buckets, n = (found[c].to_numpy() for c in ("kind", "bucket", "n"))
    for kind, classes in enumerate(out):
        classes[buckets[kinds == kind]] = np.log2(n[kinds == kind] + 1).astype(np.uint8)
    return out


def _prefix_scan(order_of, shingle: int, level: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_class, gram_class = order_of()
        for batch in batches:
            for _, _, data, offsets in words.texts(batch.column(0), piece=PIECE):
                bounds, gram, trio = _sets(data, offsets, shingle)
                n = np.diff(bounds)
                sums = np.append(np.uint64(0), np.cumsum(words.mixed(gram ^ words.BASE)))
                sid = words.mixed((sums[bounds[1:]] - sums[bounds[:-1]]) + n.astype(np.uint64))
                text = words.owners(bounds)
                rare = np.minimum.reduce([word_class[w] for w in trio])
                # one key: class of the shingle, class of its rarest word, hash; equal hashes fall back on the order in the set
                key = gram_class[gram % np.uint64(GRAM_BUCKETS)].astype(np.uint64) << np.uint64(58) | rare.astype(np.uint64) << np.uint64(52)
                key |= words.mixed(gram) >> np.uint64(12)
                order = np.argsort(key, kind="stable")
                order = order[np.argsort(text[order], kind="stable")]
                place = np.arange(len(gram)) - bounds[text]
                # ceil(n * level / 100) shingles may be missing from the prefix, less those that are needed
                length = n - (level * n + 99) // 100 + needed(level)
                pick = place < length[text]
                token, owner, place = gram[order][pick], text[pick], place[pick]
                # sets that share fewer than are needed before this place can only meet sets up to a size
                most = np.maximum((100 + level) * (n[owner] - place + needed(level) - 1) // level - n[owner], 0)
                size = n[owner] << np.int64(32) | most
                yield pa.record_batch({"token": token.view(np.int64), "sid": sid[owner].view(np.int64), "size": size})

    return scan


def _arrays(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Sorted shingles of each text as bytes."""
    for batch in batches:
        grams: list[bytes] = []
        for _, _, data, offsets in words.texts(batch.column(0), piece=PIECE):
            bounds, gram, _ = _sets(data, offsets, shingle)
            grams += [gram[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.large_binary()).cast(pa.binary()), *batch.columns[1:]], ["grams", *batch.schema.names[1:]])


def signature_bits(n: int) -> int:
    """Bits of the signature of a set of n: a power of two, between two and four per shingle within bounds."""
    return 1 << min(15, max(6, (2 * n - 1).bit_length()))


def signature(grams: np.ndarray, bits: int) -> np.ndarray:
    marks = np.zeros(bits, np.uint8)
    marks[words.mixed(grams) & np.uint64(bits - 1)] = 1
    return np.packbits(marks, bitorder="little").view(np.uint64)


def folded(signatures: list[np.ndarray]) -> np.ndarray:
    """Signatures of several lengths at the shortest of them: halves laid over each other."""
    width = min(map(len, signatures))
    return np.stack([np.bitwise_or.reduce(s.reshape(-1, width), axis=0) for s in signatures])


def overlap_bound(one: np.ndarray, n_one: int, many: np.ndarray, n_many: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlap of one set with others."""
    lacks = np.bitwise_count(one & ~many).sum(axis=1, dtype=np.int64)
    lacked = np.bitwise_count(many & ~one).sum(axis=1, dtype=np.int64)
    return np.minimum(n_one - lacks, n_many - lacked)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Overlap of two ascending arrays of distinct values."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def tile_groups(sets: list[np.ndarray], level: int = LEVEL) -> np.ndarray:
    """Group number of each set of a tile, by all links inside the tile."""
    n = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(n, kind="stable")
    sizes, marks = n[order], [signature(sets[i], signature_bits(len(sets[i]))) for i in order]
    group, left = np.full(len(sets), -1), np.ones(len(sets), bool)
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        group[order[root]] = order[root]
        while queue:
            i = queue.pop()
            low = np.searchsorted(sizes, (level * sizes[i] + 99) // 100)
            high = np.searchsorted(sizes, 100 * sizes[i] // level, "right")
            near = low + np.flatnonzero(left[low:high])
            bits = folded([marks[i], *(marks[j] for j in near)])
            near = near[linked(overlap_bound(bits[0], sizes[i], bits[1:], sizes[near]), sizes[i], sizes[near], level)]
            for j in near:
                if linked(common(sets[order[i]], sets[order[j]]), sizes[i], sizes[j], level):
                    left[j] = False
                    group[order[j]] = order[root]
                    queue.append(j)
    return group


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of one group each, from sorted batches; only the open group waits."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.zeros(batch.num_rows, bool)
        for c in columns:
            cut[1:] |= c[1:] != c[:-1]
        heads = [0, *np.flatnonzero(cut).tolist(), batch.num_rows]
        for a, b in zip(heads[:-1], heads[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if waiting and key != last:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(a, b - a))
            last = key
    if waiting:
        yield pa.Table.from_batches(waiting)


def _link_tiles(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """(a, b): each set of a tile with the first of its group there."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    for tile in groups_of(batches, ["tile", "part"]):
        if tile.num_rows > 1:
            sid = tile["sid"].to_numpy()
            group = tile_groups([np.frombuffer(x, np.uint64) for x in tile["grams"].to_pylist()], level)
            joined = np.flatnonzero(group != np.arange(len(group)))
            a.append(sid[joined])
            b.append(sid[group[joined]])
    if a:
        yield pa.record_batch({"a": np.concatenate(a), "b": np.concatenate(b)})


def _bounds_of_pairs(marks: list[np.ndarray], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlap of pairs (i, j) of sets."""
    width = np.array([len(m) for m in marks])
    flat, begin = np.concatenate(marks), np.cumsum(width) - width
    least, out = np.minimum(width[i], width[j]), np.zeros(len(i), np.int64)

    def at_width(rows: np.ndarray, w: int) -> np.ndarray:
        folds = np.zeros((len(rows), w), np.uint64)
        for k in range(int(width[rows].max()) // w):
            some = np.flatnonzero(width[rows] > k * w)
            folds[some] |= flat[begin[rows[some], None] + k * w + np.arange(w)]
        return folds

    for w in np.unique(least):
        of = np.flatnonzero(least == w)
        for low in range(0, len(of), PAIRS // 20):
            pick = of[low : low + PAIRS // 20]
            a, b = at_width(i[pick], w), at_width(j[pick], w)
            lacks = np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64)
            lacked = np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64)
            out[pick] = np.minimum(n[i[pick]] - lacks, n[j[pick]] - lacked)
    return out


def _block_pairs(blocks: list[pa.Table], level: int) -> pa.RecordBatch:
    """Pairs of sets of different groups in the blocks that their signatures do not rule out."""
    rows = pa.concat_tables(blocks)
    size = np.array([b.num_rows for b in blocks])
    n, most, sid, group, own, part, one, two = (rows[c].to_numpy() for c in ("n", "most", "sid", "c", "own", "part", "one", "two"))
    # every row with all later rows of its block
    later = np.repeat(np.cumsum(size), size) - np.arange(len(n)) - 1
    i = np.repeat(np.arange(len(n)), later)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
    # a pair is met in the band of its larger set, and across the two parts of its block
    keep = (group[i] != group[j]) & (own[i] | own[j]) & ((one[i] == two[i]) | (part[i] != part[j]))
    keep &= linked(np.minimum(n[i], n[j]), n[i], n[j], level) & (n[j] <= most[i]) & (n[i] <= most[j])
    i, j = i[keep], j[keep]
    used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    if len(used):
        marks = [np.frombuffer(x, np.uint64) for x in rows["marks"].take(pa.array(used)).to_pylist()]
        a, b = place[: len(i)], place[len(i) :]
        keep = linked(_bounds_of_pairs(marks, n[used], a, b), n[i], n[j], level)
        i, j = i[keep], j[keep]
    pairs = np.unique(np.stack([np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])]), axis=1)
    return pa.record_batch({"a": pairs[0], "b": pairs[1]})


def _meet(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    waiting, pairs, rows = [], 0, 0
    for block in groups_of(batches, ["token", "band", "one", "two"]):
        if block.num_rows > 1:
            waiting.append(block)
            pairs += block.num_rows * (block.num_rows - 1) // 2
            rows += block.num_rows
        # most blocks are of two sets: their signatures and tables weigh more than their pairs
        if pairs >= PAIRS or rows >= ROWS:
            yield _block_pairs(waiting, level)
            waiting, pairs, rows = [], 0, 0
    if waiting:
        yield _block_pairs(waiting, level)


def _verify(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        sets = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in pairs]
        good = pa.array([bool(linked(common(x, y), len(x), len(y), level)) for x, y in sets], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
        marks = [signature(s, signature_bits(len(s))).tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary())], ["sid", "marks"])


def _banded(rows: DataFrame, level: int) -> DataFrame:
    """Rows in the size band of their set (``own``) and in the next one, where larger sets may link to it.

    A shingle too late in a set's order to meet a set of the next band (``most``) stays in its own.
    """
    band = lambda size: F.floor(F.log(F.col(size).cast("double")) / math.log(100 / level)).cast("int")
    last = F.greatest(F.least(band("most"), F.col("home") + 1), F.col("home"))
    rows = rows.withColumn("home", band("n"))
    # log of no size is null, which the own band stands for
    rows = rows.withColumn("band", F.explode(F.sequence("home", F.coalesce(last, "home"))))
    return rows.withColumn("own", F.col("home") == F.col("band")).drop("home")


def _links(docs: DataFrame, sets: DataFrame, shingle: int, level: int) -> DataFrame:
    """(a, b): links between different sets that connect whatever is connected."""
    order = shared(docs.sparkSession, _rarity(docs, shingle))
    tokens = docs.select("text").mapInArrow(_prefix_scan(order, shingle, level), "token long, sid long, size long")
    met = tokens.groupBy("token").agg(F.min("sid").alias("low"), F.max("sid").alias("high"), F.count(F.lit(1)).alias("rows"))
    met = landed(met.where("low <> high").select("token", "rows"), "shared-shingles")
    members = tokens.join(met, "token").distinct()
    members = members.select("token", "sid", F.shiftright("size", 32).alias("n"), F.col("size").bitwiseAND(0xFFFFFFFF).alias("most"), "rows")
    members = landed(members, "shingle-members")
    release(met)
    for _ in range(2):
        # sets of sizes too far apart do not meet: a shingle counts where a size band holds another set too
        banded = _banded(members, level)
        bands = banded.groupBy("token", "band").agg(F.min("sid").alias("low"), F.max("sid").alias("high"), F.max("own").alias("own"))
        bands = bands.where("own AND low <> high").select("token", "band")
        kept = banded.join(bands, ["token", "band"]).select("token", "sid", "n", "most", "rows").distinct()
        # a set that has too few such shingles is linked to nothing, and others may then have too few in turn
        many = kept.groupBy("sid").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") >= needed(level)).select("sid")
        kept = landed(kept.join(many, "sid"), "shingle-members")
        release(members)
        members = kept

    # the sets that meet any other, with their most shared prefix shingles and their sorted shingles
    best = F.slice(F.sort_array(F.collect_list(F.struct("rows", "token")), asc=False), 1, ROUNDS)
    active = members.groupBy("sid").agg(best.alias("best")).join(sets.select("sid", F.col("first.at").alias("at")), "sid")
    active = docs.select("text", "at").join(active, "at").select("text", "sid", "best")
    kind = active.schema["best"].dataType.simpleString()
    active = landed(active.mapInArrow(partial(_arrays, shingle=shingle), f"grams binary, sid long, best {kind}"), "shingle-sets")

    edges = []
    for number in range(ROUNDS):
        tiles = active.where(F.size("best") > number).select("sid", "grams", F.col("best")[number]["token"].alias("tile"), F.col("best")[number]["rows"].alias("rows"))
        part = F.pmod(F.xxhash64(F.lit(number), "sid"), 1 + F.floor(F.col("rows") / TILE))
        tiles = tiles.select("tile", part.alias("part"), "sid", "grams").repartition("tile", "part").sortWithinPartitions("tile", "part", "sid")
        edges.append(landed(tiles.mapInArrow(partial(_link_tiles, level=level), "a long, b long"), "tile-links"))
    links, edges = edges, reduce(DataFrame.union, edges)
    label = components(edges)

    # what is left: prefix shingles that are shared between groups
    grouped = members.join(label, members["sid"] == label["v"], "left").select("token", "sid", "n", "most", F.coalesce("c", "sid").alias("c"))
    mixed = grouped.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("token")
    left_ = left = landed(_banded(grouped.join(mixed, "token"), level), "mixed-shingles")
    sizes = left.groupBy("token", "band").agg(F.count(F.lit(1)).alias("rows"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    sizes = sizes.select("token", "band", (1 + F.floor(F.col("rows") / TILE)).alias("parts"))
    left = left.join(sizes, ["token", "band"]).withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    marks = active.select("sid", "grams").mapInArrow(_mark, "sid long, marks binary")
    blocks = (
        left.withColumn("other", other)
        .join(marks, "sid")
        .select(
            "token", "band", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", "sid", "n", "most", "c", "marks", "own"
        )
    )
    keys = ["token", "band", "one", "two"]
    pairs = blocks.repartition(*keys).sortWithinPartitions(*keys, "sid").mapInArrow(partial(_meet, level=level), "a long, b long").distinct()
    pairs = landed(pairs, "shingle-pairs")
    side = active.select("sid", "grams")
    both = (
        pairs.join(side.select(F.col("sid").alias("a"), F.col("grams").alias("x")), "a")
        .join(side.select(F.col("sid").alias("b"), F.col("grams").alias("y")), "b")
        .select("a", "b", "x", "y")
    )
    out = landed(edges.union(both.mapInArrow(partial(_verify, level=level), "a long, b long")), "links")
    release(members, active, left_, pairs, *links)
    return out


def link_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, level: int = LEVEL) -> DataFrame:
    """(at, doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Rows are linked when 100 * common >= ``level`` * all of their distinct ``shingle``-word shingles (3 and 90 are the
    contract of op8); ``component_id`` is the smallest id
    reachable by links, and ``kept`` is true for one row of each group, the one with the smallest id (and locator).
    A text of fewer words is one shingle; null, empty and blank texts have none, are linked with nothing and each
    kept. Null ids come after all others. Repeated rows fall into one group; an empty table gives no rows; only the
    two named columns are read. Shingles and sets are known by 64-bit fingerprints.
    """
    docs = locatable(docs, "join-input")
    docs = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), locator(docs).alias("at"), F.col(f"`{key}`").alias("doc_id"))
    row = F.struct("doc_id", "at").alias("row")
    kind = docs.select(row).schema["row"].dataType.simpleString()
    rows = docs.select("text", row).mapInArrow(partial(_describe, shingle=shingle), f"sid long, n long, row {kind}")
    rows = landed(rows.select("sid", "n", "row.doc_id", "row.at"), "set-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "at")).alias("first")
    sets = landed(rows.where("sid IS NOT NULL").groupBy("sid").agg(first), "sets")
    label = components(_links(docs, sets, shingle, level))
    group = sets.join(label, sets["sid"] == label["v"], "left").select("sid", "first", F.coalesce("c", "sid").alias("c"))
    heads = group.groupBy("c").agg(F.min("first").alias("head"))
    heads = group.join(heads, "c").select("sid", "head")
    return rows.join(heads, "sid", "left").select(
        "at",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
        (F.col("sid").isNull() | (F.col("at") == F.col("head.at"))).alias("kept"),
    )


def first_of_groups(docs: DataFrame, shingle: int = SHINGLE, level: int = LEVEL) -> DataFrame:
    """The rows of ``docs`` without those that are linked to a kept row's group, by the rule of ``link_groups``."""
    docs = locatable(docs, "join-input")
    kept = link_groups(docs, shingle=shingle, level=level).where("kept").select(F.col("at").alias("_at"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), locator(docs).alias("at"))
    return rows.join(kept, F.col("at") == F.col("_at"), "left_semi").select("record.*")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op8_jaccard_join": op8_jaccard_join}
SQL = {
    "op8_jaccard_join": r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), s AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                            ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g
        FROM d
    ), p AS (
        SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s
    ), pairs AS (
        SELECT a.doc_id AS x, b.doc_id AS y
        FROM p a JOIN p b ON a.gram = b.gram AND a.doc_id < b.doc_id AND 10 * b.n >= 9 * a.n AND 10 * a.n >= 9 * b.n
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 190 * count(*) >= 90 * (a.n + b.n)
    ), e AS (
        SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs
    ), reach(v, c) AS (
        SELECT doc_id, doc_id FROM s UNION SELECT e.y, r.c FROM reach r JOIN e ON e.x = r.v
    )
    SELECT s.doc_id, len(g)::BIGINT AS n_shingles, min(c) AS component_id FROM s JOIN reach ON v = s.doc_id GROUP BY ALL
    """
}
