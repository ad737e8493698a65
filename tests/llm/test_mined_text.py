"""Collocations, repeated word runs and whitening against brute force on hard rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.llm import collocations, substrings, whitening, words
from paceline.llm.rows import table
from tests.llm.cases import hard_rows, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = "group chunk words phrase f a l r k part rank above key file one two anchor lead listed spans kept starts vector dim high low".split()


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in CLASHING:
        df = df.withColumn(name, F.lit("other"))
    return df.repartition(3)


def brute_phrases(rows, most, least, share, top):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for m in range(1, most + 1):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, found in counts.items():
        good = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in good.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        best = []
        for p, a in good.items():
            score, _, l, r = min((10**6 * a * a // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
            if 100 * inside[p] < share * a:
                best.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(best)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return out


def phrase_rows():
    draw = random.Random(3)
    vocabulary = ["Sea", "wind", "old", "harbour", "élan", "x.y", "a\x00b", "n o", "NEW", "york"]
    rows = [(i, " ".join(draw.choice(vocabulary) + draw.choice(["", "", ",", ".", "\n", "\t"]) for _ in range(draw.randrange(1, 400))), ["en", None, "und", ""][i % 4], "a") for i in range(60)]
    copied = rows[3][1]
    periodic = "ab cd " * 700 + "ab"
    return hard_rows() + rows + [(1000 + i, copied + f" tail{i}", "en", "b") for i in range(40)] + [(2000, periodic, "de", "b"), (2001, periodic, "de", "b"), (2002, "....", "de", "b")]


@pytest.mark.parametrize("most,bits,top", [(3, collocations.FILTER_BITS, 2000), (3, 64, 7), (4, 1 << 12, 50)])
def test_collocations(spark, most, bits, top):
    rows = phrase_rows()
    found = collocations.collocations(documents(spark, rows), most=most, bits=bits, top=top).collect()
    want = brute_phrases(rows, most, 10, 50, top)
    assert {tuple(r) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("most", [2, 3, 5])
def test_chunks_hold_every_phrase_once(most):
    texts = [t for _, t, _, _ in phrase_rows() if t]
    for text in texts:
        raw = np.frombuffer(text.translate(LOWER).encode(), np.uint8)
        _, chunk, size = collocations.chunks(raw, np.array([0, len(raw)]), most)
        assert size.max(initial=0) <= collocations.LONGEST
        got = Counter()
        for c, n in zip(chunk.to_pylist(), size, strict=True):
            assert c.endswith("\n")
            at = 0
            for piece in c[:-1].split("\n"):
                w = re.split("[ \t]", piece)
                for i in range(len(w)):
                    if at + i < n:
                        got.update(tuple(w[i : i + m]) for m in range(1, most + 1) if i + m <= len(w))
                at += len(w)
        want = Counter()
        for piece in re.split("[.,;:!?\x0a-\x0d]", text.translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            want.update(tuple(w[i : i + m]) for m in range(1, most + 1) for i in range(len(w) - m + 1))
        assert got == want


def test_equal_text_is_cut_alike():
    body = " ".join(f"w{i * i % 97}x{i % 13}" for i in range(600))
    both = []
    for before in ("", "quite other words come first here "):
        raw = np.frombuffer((before + body).encode(), np.uint8)
        both.append(Counter(collocations.chunks(raw, np.array([0, len(raw)]), 3)[1].to_pylist()))
    assert sum((both[0] & both[1]).values()) >= 0.8 * sum(both[0].values())


def test_scores_beyond_64_bits(spark):
    a = 9 * 10**9
    row = spark.range(1).select(F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * CAST({a} AS DECIMAL(19,0)) * CAST({a} AS DECIMAL(19,0))) div (CAST({a + 1} AS DECIMAL(19,0)) * CAST({a + 2} AS DECIMAL(19,0)))"))
    assert row.first()[0] == 10**6 * a * a // ((a + 1) * (a + 2))


def brute_repeats(rows, length):
    worded = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t, _, _ in rows]
    first = {}
    for (key, *_), w in zip(rows, worded, strict=True):
        if key is not None:
            for i in range(len(w) - length + 1):
                run = tuple(w[i : i + length])
                first[run] = min(first.get(run, key), key)
    out = Counter()
    for (key, *_), w in zip(rows, worded, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if key is not None and first[tuple(w[i : i + length])] < key:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[(key, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def repeat_rows():
    """Passages at many places, of the threshold's length and one less, copies, runs of one word, and a hot passage."""
    passage, short = prose(70, 50), prose(71, 49)
    rows = hard_rows()
    rows += [(300 + i, prose(200 + i, 30 + i) + "  " + (passage if i % 2 else short) + "\n" + prose(400 + i, 40), "en", "a") for i in range(40)]
    rows += [(500, "again " * 120, "en", "a"), (501, "again " * 70, "en", "a"), (499, prose(9, 60) + " " + prose(9, 60), "en", "a")]
    long = prose(72, 200)
    rows += [(600 + i, " ".join(long.split(" ")[i : i + 90]), "en", "a") for i in (90, 40, 0, 110, 20)]
    return rows + [(290, passage + " " + prose(73, 20), "en", "a"), (291, None, "en", "a")]


@pytest.mark.parametrize("length,seed", [(50, 25), (50, 50), (50, 7), (12, 5), (1, 1)])
def test_repeated_words(spark, length, seed):
    rows = repeat_rows()
    found = substrings.repeated_words(documents(spark, rows), length=length, seed=seed).collect()
    got = Counter()
    for r in found:
        removed = sum(r.spans[1::2]) - sum(r.spans[::2])
        # maximal runs: in order and apart
        assert all(a < b for a, b in zip(r.spans, r.spans[1:]))
        got[(r.doc_id, r.n_words, removed, r.whole_sha256 if r.kept is None else hashlib.sha256(r.kept.encode()).hexdigest())] += 1
    assert got == brute_repeats(rows, length)


def test_windows_select_one_anchor_by_content():
    text = prose(5, 3000)
    raw = np.frombuffer((text + " " + text).encode(), np.uint8)
    starts, ends, bounds = words.spans(raw, np.array([0, len(raw)]), words.NOT_SPACE)
    window, at = substrings.selected(words.word_prints(raw, starts, ends), bounds, 50, 25)
    assert (at >= window).all() and (at + 25 <= window + 50).all()
    n = len(text.split(" "))
    assert (at[: n - 49] + n == at[n : 2 * n - 49]).all()
    assert len(np.unique(at)) < len(window) / 8


def test_second_fingerprints_tell_words_apart():
    rng = np.random.default_rng(1)
    found = {bytes(rng.integers(97, 123, rng.integers(1, 150)).astype(np.uint8)) for _ in range(20000)} | {b"ab", b"ba", b"a" * 64, b"a" * 65, b"a" * 128}
    raw = b" ".join(found)
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = words.spans(data, np.array([0, len(raw)]), words.NOT_SPACE)
    assert len(np.unique(substrings._second_prints(data, starts, ends))) == len(found)


def whole_numbers(rows):
    keep = [(k, v) for k, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    return [k for k, _ in keep], np.array([[int(np.floor(64 * np.float64(np.float32(c)))) + 1000000 for c in v] for _, v in keep])


def test_whitening(spark, hard):
    rows = [(r.vec_id, r.embedding) for r in table(spark, hard, "embeddings").collect()]
    keys, x = whole_numbers(rows)
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = whitening.op12_whitening(spark, hard).collect()
    dims = x.shape[1]
    live = int((values > dims * np.finfo(float).eps * values[0]).sum())
    assert live < dims  # the tables hold entries that do not vary enough for all components
    assert len(found) == n * dims and {r.n for r in found} == {n}
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    assert Counter((r.vec_id, r.deviation) for r in found if r.component == 1) == Counter(zip(keys, deviation.tolist()))
    for component in range(1, dims + 1):
        mine = [r for r in found if r.component == component]
        assert abs(mine[0].explained - values[component - 1] / values.sum()) <= 1e-12
        if component > live:
            assert all(r.whitened is None for r in mine)
            continue
        want = centred @ vectors[:, component - 1] / np.sqrt(values[component - 1])
        by_row = lambda sign: sorted((k is None, k or 0, round(sign * w, 6)) for k, w in zip(keys, want))
        got = sorted((r.vec_id is None, r.vec_id or 0, round(r.whitened, 6)) for r in mine)
        assert got in (by_row(1), by_row(-1))
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error <= 1e-9


@pytest.mark.parametrize(
    "matrix",
    [
        np.cov(np.random.default_rng(0).standard_normal((500, 64)).T),
        np.cov(np.random.default_rng(1).standard_normal((20, 64)).T),
        1e10 * np.cov((np.random.default_rng(2).standard_normal((900, 40)) * np.logspace(0, -8, 40)).T),
        np.diag([3.0, 3, 3, 1, 1, 0, 0, 0]),
        np.zeros((4, 4)),
        np.array([[0.0, 1], [1, 0]]),
        np.ones((9, 9)),
        np.eye(5) + 1e-9 * np.diag(range(5)),
        np.array([[2.0]]),
    ],
)
def test_spectral_division(matrix):
    values, vectors = whitening.eigen(matrix)
    scale = max(np.abs(matrix).max(), 1e-300) * len(matrix)
    assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1]).max() <= 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(matrix))).max() <= 1e-13 * len(matrix)
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-13 * scale


def test_polar_factor():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    signs = np.where(np.arange(30) < 11, 1.0, -1.0)
    a = q * (signs * np.logspace(0, -9, 30)) @ q.T
    assert np.abs(whitening.polar(a) - q * signs @ q.T).max() <= 1e-6


def test_large_entries_and_unlike_lengths(spark):
    exact = spark.createDataFrame([(i, [2.0**30 * i, -(2.0**40), float(i % 2)]) for i in range(9)], "vec_id long, embedding array<double>")
    found = whitening.components_of(exact).where("component = 1").collect()
    x = np.array([[(64 * 2**30 * i) + 10**6, -(64 * 2**40) + 10**6, 64 * (i % 2) + 10**6] for i in range(9)], object)
    sums = x.sum(axis=0)
    assert {r.vec_id: int(r.deviation) for r in found} == {i: sum((9 * v - s) ** 2 for v, s in zip(row, sums)) for i, row in enumerate(x)}
    unlike = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="1 to 2"):
        whitening.components_of(unlike)
