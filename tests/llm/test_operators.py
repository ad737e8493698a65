"""Every operator on the hard tables against brute force, on empty tables, and against its SQL."""

import hashlib
import inspect
import math
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import compare, connect
from paceline import llm
from paceline.llm import decontamination, exact_dedup, jaccard_join, language, license_scan, mixing, repeated_text, sharding, toxicity, url_filter
from tests.llm.cases import hard_rows, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
NOT_SPACE = re.compile("[^\x20\x09-\x0d]+")


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_empty_tables(spark, bare, name):
    assert llm.queries()[name](spark, bare).collect() == []


def test_empty_pipeline(spark, bare):
    assert corpus_pipeline.run(spark, bare).collect() == []


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, small, name):
    ok, message = compare(spark, connect(small), small, name, llm.queries()[name], llm.oracle_sql()[name])
    assert ok, message


def shingles(text):
    w = NOT_SPACE.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def groups(sets, ids):
    """Group representative of each row by all links, over all pairs."""
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(sets)):
        members[find(i)].append(i)
    return {i: min((ids[j] for j in m if ids[j] is not None), default=None) for m in members.values() for i in m}


def test_jaccard_join(spark, hard):
    rows = hard_rows()
    sets = [shingles(r[1]) for r in rows]
    group = groups(sets, [r[0] for r in rows])
    want = Counter((r[0], len(sets[i]), group[i] if sets[i] else r[0]) for i, r in enumerate(rows))
    found = jaccard_join.link_groups(documents(spark, hard)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == want
    # one row of each group stays, every row without shingles stays
    assert sum(r.kept for r in found) == len({find for i, find in group.items() if sets[i]} - {None}) + 1 + sum(not s for s in sets)


def test_jaccard_join_near_copies(spark, tmp_path, monkeypatch):
    """Many near copies around one text and a passage that unlike texts share, with tiles split in small parts."""
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    base, passage = prose(1, 200).split(" "), prose(2, 60)
    rows = []
    for i in range(60):
        changed = list(base)
        for k in range(1 + i % 5):
            changed[(i * 37 + k * 11) % 200] = f"edit{i}x{k}"
        rows.append((i, " ".join(changed)))
    rows += [(100 + i, prose(100 + i, 60) + " " + passage) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    sets = [shingles(t) for _, t in rows]
    group = groups(sets, [i for i, _ in rows])
    found = jaccard_join.link_groups(documents(spark, tmp_path)).collect()
    assert {r.doc_id: r.component_id for r in found} == {r[0]: group[i] for i, r in enumerate(rows)}


def test_signatures_bound_overlap():
    import numpy as np

    draw = np.random.default_rng(3)
    for _ in range(50):
        n, m, both = draw.integers(1, 400, 3)
        pool = draw.choice(1 << 60, n + m + both, replace=False).astype(np.uint64)
        a, b = np.sort(np.append(pool[:n], pool[n + m :])), np.sort(pool[n:])
        marks = jaccard_join.folded([jaccard_join.signature(x, jaccard_join.signature_bits(len(x))) for x in (a, b)])
        bound = jaccard_join.overlap_bound(marks[0], len(a), marks[1:], np.array([len(b)]))[0]
        assert jaccard_join.common(a, b) == both <= bound


def brute_repeats(texts, size=400):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out


@pytest.mark.parametrize("split, id_bits", [(repeated_text.SPLIT, 64), (0, 64), (repeated_text.SPLIT, 2)])
def test_repeated_text(spark, hard, split, id_bits):
    """With numbers of two bits nearly all texts share theirs with unlike ones."""
    rows = hard_rows()
    want = Counter((r[0], *w) for r, w in zip(rows, brute_repeats([r[1] for r in rows]), strict=True))
    found = repeated_text.repeated_spans(documents(spark, hard), split=split, id_bits=id_bits).collect()
    got = Counter(
        (r.doc_id, r.n_bytes, sum(r.spans[1::2]) - sum(r.spans[::2]), len(r.spans) // 2, sha(bytes(r.kept)) if r.kept is not None else r.whole_sha256) for r in found
    )
    assert got == want


def test_repeated_text_low_variety(spark, tmp_path):
    """Zero bytes, periods, overlaps and repeats that differ by single bytes."""
    import random

    draw = random.Random(5)
    blocks = ["".join(draw.choice("ab\x00") for _ in range(500)), "a" * 900, "abc" * 300, "\x00" * 450]
    rows = []
    for i in range(40):
        t = "".join(draw.choice(blocks)[draw.randrange(60) : draw.randrange(380, 900)] for _ in range(draw.randrange(1, 4)))
        rows.append((i, t[: draw.randrange(1, 1500)]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {r[0]: w for r, w in zip(rows, brute_repeats([t for _, t in rows]), strict=True)}
    got = {r.doc_id: tuple(r)[1:] for r in repeated_text.op6_repeated_text(spark, str(tmp_path)).collect()}
    assert got == want


@pytest.mark.parametrize("digest", [None, lambda c: F.length(c) % 3])
def test_exact_dedup(spark, hard, digest):
    rows = [(r[0], r[1] or "") for r in hard_rows()]
    size = Counter(t for _, t in rows)
    last = {t: max((i for i, x in rows if x == t and i is not None), default=None) for t in size}
    found = exact_dedup.exact_dedup(spark, f"{hard}/documents.parquet", digest=digest, files_per_batch=1, rows_per_copy=2).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == Counter((i, last[t], size[t], sha(t)) for i, t in rows)
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert kept == Counter(sha(t) for t in size)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def hits(words, items):
    """Hit word places and ids of items, by trying every window everywhere."""
    places, names = set(), set()
    for name, item in items:
        n = min(10, len(item))
        windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                places |= set(range(i, i + n))
                names.add(name)
    return places, sorted(names)


@pytest.mark.parametrize("block", [500_000, 1])
def test_contamination(spark, hard, block):
    bench = spark.read.parquet(f"{hard}/benchmark.parquet")
    items = [("" if r.item_id is None else str(r.item_id), ALNUM.findall((r.text or "").translate(LOWER))) for r in bench.collect()]
    want = Counter()
    for i, text, _, _ in hard_rows():
        w = ALNUM.findall((text or "").translate(LOWER))
        places, names = hits(w, items)
        want[(i, len(w), len(places), ",".join(names), sha(",".join(names)))] += 1
    found = decontamination.contamination(documents(spark, hard), bench, block=block).collect()
    assert Counter((r.record.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.items_sha256) for r in found) == want
    assert any(r.n_hit for r in found)
    for r in found:
        assert sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_hit and r.record.size == "other"


def test_mix(spark, hard):
    docs = documents(spark, hard)
    mixed, schedule = mixing.mix(docs, block=8)
    found, slots = mixed.collect(), schedule.collect()
    rows = hard_rows()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((r[0], len(NOT_SPACE.findall(r[1] or ""))) for r in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in found)
    assert sum(s.words for s in slots) == sum(r.taken for r in found)
    # a slot holds one source and at most a block
    filled = Counter()
    for s in slots:
        filled[s.slot] += s.words
    assert max(filled.values()) <= 8
    taken, target, size = defaultdict(int), {}, {}
    for r in found:
        key = (r.source_size, r.target)
        taken[key] += r.taken
        target[key], size[key] = r.target, r.source_size
    for key in taken:
        assert abs(taken[key] - target[key]) <= 8 * 8 and target[key] <= 3 * size[key] + 1e-6
    again = mixing.mix(docs, block=8)[0].collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))
    copies = Counter()
    for r in found:
        copies[r.doc_id] += r.copies
    out = mixing.mixed_rows(docs, block=8)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == +copies


def test_targets_stop_and_reshare(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 5)], "source string, size long")
    target = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # 1115 by weights 1 2 3 1: null stops at 15, a at 30; 1070 by 2 and 3 stops b at 300
    assert target == {None: 15.0, "a": 30.0, "b": 300.0, "c": 770.0}


def test_shuffle(spark, hard):
    docs = documents(spark, hard)
    for size in (1 << 24, 1 << 10):
        found = sharding.external_shuffle(docs, shards=4, bucket_bytes=size).collect()
        assert Counter((r.record.doc_id, r.record.text, r.record.shard) for r in found) == Counter((r[0], r[1], "other") for r in hard_rows())
        for shard in range(4):
            slots = sorted(r.slot for r in found if r.shard == shard)
            assert slots == list(range(len(slots)))
        counts = Counter(r.shard for r in found)
        assert max(counts.values()) - min(counts.values()) <= 1
        again = sharding.external_shuffle(docs.repartition(5), shards=4, bucket_bytes=size).collect()
        assert {(r.record.doc_id, r.record.text, r.shard, r.slot) for r in again} == {(r.record.doc_id, r.record.text, r.shard, r.slot) for r in found}
    order = [r.record.doc_id for r in sorted(found, key=lambda r: (r.slot, r.shard))]
    assert order != sorted(order, key=lambda x: (x is None, x))


def test_shuffle_of_equal_rows(spark, tmp_path):
    """Rows without a key and with one text fill more than a bucket; others stay where they were."""
    rows = [(None, "same text")] * 5000 + [(i, f"text {i}") for i in range(500)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    shuffled = sharding.external_shuffle(docs, shards=4, bucket_bytes=1 << 14)
    found = shuffled.collect()
    assert Counter((r.record.doc_id, r.record.text) for r in found) == Counter(rows)
    assert sorted((r.shard, r.slot) for r in found) == [(s, i) for s in range(4) for i in range(1375)]
    again = sharding.external_shuffle(docs, shards=4, bucket_bytes=1 << 14).collect()
    assert {(r.record.doc_id, r.shard, r.slot) for r in again} == {(r.record.doc_id, r.shard, r.slot) for r in found}
    # 25 buckets of about 220 rows each: other rows lie between the equal ones everywhere
    order = [r.record.doc_id for r in sorted(found, key=lambda r: (r.slot, r.shard))]
    between = [i for i, key in enumerate(order) if key is not None]
    assert max(b - a for a, b in zip(between, between[1:])) < 500


def test_shuffle_against_two_plain_passes(spark, hard):
    """The same places from a dictionary of buckets and a swap at a time."""
    docs, shards, limit = documents(spark, hard), 4, 1 << 10
    marks = docs.select("doc_id", "text", F.xxhash64(F.lit(20261), "doc_id", F.crc32(F.coalesce("text", F.lit("")))).alias("mark"),
                        F.xxhash64(F.lit(20261), *docs.columns).alias("tie")).collect()
    n = 1 + sum(len((r.text or "").encode()) + 64 for r in marks) // limit
    buckets = {}
    for r in marks:
        buckets.setdefault(((r.mark % 2**64) >> 8) % n, []).append(r)
    want, place = [], 0
    for number in sorted(buckets):
        rows = sorted(buckets[number], key=lambda r: (r.mark, r.tie))
        for i in np.random.Generator(np.random.PCG64([20261, number])).permutation(len(rows)):
            want.append((rows[i].doc_id, rows[i].text, place % shards, place // shards))
            place += 1
    found = sharding.external_shuffle(docs, shards=shards, bucket_bytes=limit).collect()
    assert Counter((r.record.doc_id, r.record.text, r.shard, r.slot) for r in found) == Counter(want)


def test_write_shards(spark, hard, tmp_path):
    sharding.write_shards(sharding.external_shuffle(documents(spark, hard), shards=4), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == len(hard_rows()) and back.select("shard").distinct().count() == 4


def test_language(spark, hard):
    found = language.op4_language(spark, hard).collect()
    text = dict((r[0], r[1]) for r in hard_rows() if r[0] not in (6, 7))
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "fr", "und")
        if r.doc_id in text:
            letters = any(c.isalpha() for c in text[r.doc_id] or "")
            assert (r.lang_pred == "und") == (not letters)


def test_language_held_out(spark):
    folder = "/root/testdata/sf0.01"
    rows = language.op4_language(spark, folder).join(documents(spark, folder).select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_counts_reach_the_driver_as_columns(spark, hard, monkeypatch):
    """The driver holds neither a row object per count of the trees nor a job per part of the counts of the join."""
    frames, collected = type(spark.range(1)), []
    langs = len({r[2] for r in hard_rows()})
    monkeypatch.setattr(frames, "collect", lambda self, f=frames.collect: collected.append(f(self)) or collected[-1])
    monkeypatch.setattr(frames, "toLocalIterator", lambda self, *given: pytest.fail("a job per part"))
    trees = language.train(documents(spark, hard))
    assert trees.languages and max(map(len, collected)) <= langs
    order = jaccard_join._rarity(documents(spark, hard), 3)
    batch = pa.record_batch({"text": [r[1] for r in documents(spark, hard).select("doc_id", "text").collect()]})
    want = [np.zeros_like(x) for x in order]
    for kind, found in enumerate(jaccard_join._count(iter([batch]), 3)):
        for bucket, n in zip(found["bucket"].to_pylist(), found["n"].to_pylist()):
            want[kind][bucket] = int(math.log2(n + 1))
    assert (order[0] == want[0]).all() and order[0].any()


def test_code_lengths_are_exact():
    """The probabilities of all bytes after any context add up to one, so code lengths are those of a real code."""
    import numpy as np

    texts = ["abracadabra", "banana band", "cab"]
    grams = Counter()
    for t in texts:
        padded = b"\0\0\0" + t.encode()
        for i in range(len(t)):
            grams[int.from_bytes(padded[i : i + 4], "big")] += 1
    trees = language.build_trees([("x", g, n) for g, n in grams.items()])
    unseen = 257 - trees.bits.shape[1]
    p = np.exp2(-trees.bits[:, :, 0].astype(float))
    assert np.allclose(p[:, :-1].sum(1) + p[:, -1] * unseen, 1, atol=1e-5)
    data = np.frombuffer(b"banana", np.uint8)
    assert trees.code_lengths(data, np.array([0, 6])).shape == (1, 1)
    assert trees.code_lengths(data, np.array([0, 6]))[0, 0] < trees.code_lengths(np.frombuffer(b"nnnnnn", np.uint8), np.array([0, 6]))[0, 0]


def test_toxicity(spark, hard):
    found = toxicity.op5_toxicity(spark, hard).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in hard_rows())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


def test_toxicity_sample_size():
    assert inspect.signature(toxicity.train).parameters["rows_per_label"].default == 4000


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.op5_toxicity(spark, folder).where("held_out").join(labels, "doc_id").where("toxic IS NOT NULL").collect()
    good = [r.score for r in rows if r.toxic == 0]
    bad = [r.score for r in rows if r.toxic == 1]
    assert sum((b > g) + 0.5 * (b == g) for b in bad for g in good) >= 0.95 * len(good) * len(bad)


def test_network_gradients():
    """Learning follows the numerical gradient of the loss."""
    import numpy as np

    rows = ["good day to all", "you vile thing indeed", "fine words here"]
    y, w = np.array([0.0, 1.0, 0.0]), np.ones(3)
    f, _ = next(toxicity._pieces(rows, y))
    _, first, size = f.windows()

    def loss(net):
        p = toxicity.sigmoid(net.score_windows(net.inputs(f), first, size).astype(float))
        return float(-np.log(np.where(y > 0, p, 1 - p)).mean())

    fresh = lambda: toxicity.Network.fresh([np.zeros(toxicity.BUCKETS, np.float32)] * 3, 1)
    for name in ("xf", "hb", "attend", "focus", "out"):
        net, memory = fresh(), {}
        net.learn(f, first, size, y, w, memory, 0.0)
        grad = memory[name][0] / 0.1
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        up, down = fresh(), fresh()
        up.weights[name][at] += 0.01
        down.weights[name][at] -= 0.01
        assert abs((loss(up) - loss(down)) / 0.02 - grad[at]) < 0.03 * abs(grad[at]) + 1e-4


def test_url_rules(spark, hard):
    found = {r.page_id: r for r in url_filter.judge(spark.read.parquet(f"{hard}/pages.parquet")).collect()}
    assert [(found[i].host, found[i].path, found[i].rule) for i in range(10)] == [
        ("", "", None),
        ("", "", None),
        ("", "", None),
        ("", "", None),
        ("a.example.org", "/es/1", "example.org/es/"),
        ("example.org", "/en/12", "example.org/en/1"),
        ("notexample.org", "/es/1", "org/"),
        ("x.com", "/fr/", "com/fr/"),
        ("com", "/de/a", "com/de/"),
        ("a.example.org", "/es/1", "example.org/es/"),
    ]
    assert [found[i].verdict for i in range(4, 10)] == ["block", "block", "allow", "allow", "block", "block"]


def test_url_templates(spark):
    rules = (("h.net/bad/", "block"), ("h.net/good/", "allow"))
    urls = [f"http://h.net/{kind}/{i}" for i in range(30) for kind in ("bad", "good")] + ["http://h.net/bad", "http://h.net/other/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r.path: r for r in url_filter.judge(pages, rules=rules).collect()}
    assert found["/bad/3"].template == "/bad/*" and found["/good/7"].template == "/good/*"
    assert found["/bad/3"].verdict == "block" and found["/good/7"].verdict == "allow" and found["/other/1"].verdict == "allow"


def test_licences(spark):
    rows = [
        (1, "Some prose here.\nReleased under the MIT License.\nMore prose."),
        (2, "some prose; licensed under the apache licence"),
        (3, dict(license_scan.TEMPLATES[::-1])["ISC"].upper()),
        (4, None),
        (5, "word"),
        (6, "Prose first. Licensed under CC BY-NC 4.0. Prose last."),
        (7, "Licensed under the Apache License, Version 2.0.\n\nReleased under the MIT License."),
        (8, "Some prose. More!\n\n!!! \n"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("dice", F.lit("other"))
    found = {r.record.doc_id: (r.licences, r.dice) for r in license_scan.scan_licences(docs).collect()}
    assert found[1] == (["MIT"], 1.0) and found[3] == (["ISC"], 1.0) and found[6] == (["CC-BY-NC-4.0"], 1.0)
    assert found[2] == found[4] == found[5] == found[8] == ([], None)
    assert found[7] == (["Apache-2.0", "MIT"], 1.0)


def test_wrapped_licences(spark):
    """Notices wrapped over lines, with other line ends, comment marks and neighbours on their lines."""
    texts = dict(license_scan.TEMPLATES)
    mit, gpl = texts["MIT"], texts["GPL-3.0"]
    lines = textwrap.wrap(mit, 76)
    extra = mit.replace("any person", "any natural or legal person").split()
    rows = [
        "MIT License\n\nCopyright (c) 2020 A\n\n" + "\n".join(lines) + "\n\nThe above notice.",
        "MIT License\r\n\r\nCopyright (c) 2020 A\r\n\r\n" + "\r\n".join(lines) + "\r\n\r\nThe above notice.",
        "// MIT License\n//\n// Copyright (c) 2020 A\n//\n" + "".join(f"// {x}\n" for x in lines) + "//\n// The above notice.\nint x;",
        "Title\n  \n" + "\n".join(lines) + "\n \t\nMore words here",
        "#!/bin/sh\n# tool, copyright 2020 by A B C D E F\n" + "".join(f"# {x}\n" for x in textwrap.wrap(gpl, 60)) + "# see the file\nexit 0",
        "a b c " * 40 + mit + " d e f" * 40,
        "a b c " * 40 + " ".join(extra) + " d e f" * 40,
        "a b c " * 40 + " ".join(mit.split()[:30]) + " d e f" * 40,
        "Licensed under CC BY-SA 3.0. Not free.",
    ]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.record.doc_id: (r.licences, r.dice) for r in license_scan.scan_licences(docs).collect()}
    assert all(found[i] == (["MIT"], 1.0) for i in (0, 1, 2, 3, 5)) and found[4] == (["GPL-3.0"], 1.0)
    b = len(license_scan.bigrams(license_scan.normal_words(mit)))
    assert found[6] == (["MIT"], 2 * (b - 1) / (2 * b + 3)) and found[7] == found[8] == ([], None)


def test_near_duplicates_stage(spark, tmp_path):
    """Four spaced substitutions in 200 words: near copies by 5-word shingles from 0.8, not by op8's contract."""
    base = [f"w{i}" for i in range(200)]
    changed = [f"x{i}" if i in (40, 80, 120, 160) else w for i, w in enumerate(base)]
    far = [f"y{i}" if i in (20, 40, 80, 120, 160) else w for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(changed)), (3, " ".join(far)), (4, "a b c d"), (5, "a  b c d"), (6, "a b c"), (7, None), (8, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = documents(spark, tmp_path)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()) == [1, 3, 4, 6, 7, 8]
    assert sorted(r.doc_id for r in jaccard_join.first_of_groups(docs).collect()) == [1, 2, 3, 4, 6, 7, 8]


def test_split_buckets_are_not_gathered():
    """Phrases of a split bucket reach no task as bytes; their strings are counted."""
    import pyarrow as pa

    passage = prose(3, 400)[:600]
    texts = pa.array([prose(1000 + i, 60)[:200] + passage for i in range(50)])
    tids = pa.array(range(50))
    parsed = [b.to_pylist() for b in repeated_text._parse(iter([pa.RecordBatch.from_arrays([texts, tids], ["text", "tid"])]))][0]
    listed = [[{**p, "single": True, "split": True} for p in parsed if p["tid"] == i] for i in range(50)]
    batch = pa.RecordBatch.from_arrays([texts, tids, pa.array(listed)], ["text", "tid", "phrases"])
    assert sum(b.num_rows for b in repeated_text._contexts(iter([batch]))) == 0
    rows = [r for b in repeated_text._strings(iter([batch])) for r in b.to_pylist()]
    same = Counter((r["bucket"], r["distance"], r["print"]) for r in rows)
    found = {i: sorted(r["start"] for r in rows if r["tid"] == i and same[r["bucket"], r["distance"], r["print"]] > 1) for i in range(50)}
    data = [t.encode() for t in texts.to_pylist()]
    seen = Counter(d[i : i + 400] for d in data for i in range(len(d) - 399))
    assert found == {k: [i for i in range(len(d) - 399) if seen[d[i : i + 400]] > 1] for k, d in enumerate(data)} and all(map(len, found.values()))


def test_pipeline_stages(spark, hard, tmp_path):
    """Each stage against a plain version on its own input; the run equals its stages."""
    docs = documents(spark, hard)
    columns, steps = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, hard).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns[: len(columns)] == columns or name == "sharding"
        steps.append(docs.collect())
    rows = Counter((r[0], r[1]) for r in hard_rows())
    # a text goes without letters; so far no text is coded worse than its bytes
    known = Counter({k: n for k, n in rows.items() if any(c.isalpha() for c in k[1] or "")})
    assert Counter((r.doc_id, r.text) for r in steps[0]) == known
    items = list(known.elements())
    sets = [shingles(t) for _, t in items]
    group = groups(sets, [i for i, _ in items])
    assert len(steps[1]) == len({(g if g is not None else "none") for g in group.values()})
    assert {r.doc_id for r in steps[1]} == set(group.values())
    bench = [("x", ALNUM.findall((r.text or "").translate(LOWER))) for r in spark.read.parquet(f"{hard}/benchmark.parquet").collect()]
    clean = [r for r in steps[1] if not hits(ALNUM.findall(r.text.translate(LOWER)), bench)[0]]
    assert Counter(steps[2]) == Counter(clean) and len(clean) < len(steps[1])
    copies = Counter()
    for r in mixing.mix(spark.read.parquet(f"{tmp_path}/2"))[0].collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in steps[3]) == +copies
    assert Counter((r.doc_id, r.text) for r in steps[4]) == Counter((r.doc_id, r.text) for r in steps[3])
    run = corpus_pipeline.run(spark, hard).collect()
    assert Counter((r.doc_id, r.shard, r.slot) for r in run) == Counter((r.doc_id, r.shard, r.slot) for r in steps[4])
