"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters the network with three learnt vectors: one of the word, one of its first characters, and the mean over
its character 4-grams (all by hashed bucket). A forward and a backward recurrent layer read a window of words, attention
pools their states and a logistic unit scores the window. Windows of 32 words overlap by half (one starts every 16 words);
the text's score is that of its worst window, on a calibrated scale. A passage of 18 to 32 words can lie in no window whole.

Only texts are labelled, so training alternates: the worst window of each labelled text under the current network
stands for it, and the network is fitted to those windows. Vectors start from the log-odds of their bucket in one part of
the sample, the network is fitted on a second part, and the scale on a third.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import words
from paceline.llm.language import training_row
from paceline.llm.rows import shared, table

# Words of a window and distance between windows
WIDTH = 32
STRIDE = 16
# Buckets of each kind of vector, their lengths (word, prefix, 4-grams), states per direction and of the attention
BUCKETS = 1 << 18
SIZES = (4, 3, 3)
HIDDEN = 8
ATTENTION = 8
# Windows taken together
TOGETHER = 4096


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Features:
    """Buckets of the words of some texts."""

    word: np.ndarray
    prefix: np.ndarray
    gram: np.ndarray
    gram_bounds: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Features:
        starts, ends, bounds = words.spans(data, offsets, words.ALNUM)
        sums = words.prefix_sums(data)
        size = ends - starts
        n = np.maximum(size - 3, 1)
        first = np.cumsum(n) - n
        at = np.repeat(starts - first, n) + np.arange(n.sum())
        stop = np.minimum(at + 4, np.repeat(ends, n))

        def bucket(a, b):
            return (words.span_prints(sums, a, b) >> np.uint64(46)).astype(np.int32) % BUCKETS

        return cls(bucket(starts, ends), bucket(starts, np.minimum(starts + 5, ends)), bucket(at, stop), np.append(first, n.sum()), bounds)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, words) of all windows."""
        n = np.diff(self.bounds)
        many = np.where(n > 0, 1 + np.maximum(0, -(-(n - WIDTH) // STRIDE)), 0)
        text = np.repeat(np.arange(len(n)), many)
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        first = self.bounds[text] + inner * STRIDE
        return text, first, np.minimum(WIDTH, self.bounds[text + 1] - first)


@dataclass
class Network:
    """Vectors, both recurrent layers, attention, output and scale."""

    vectors: list[np.ndarray]
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def fresh(cls, log_odds: list[np.ndarray], seed: int) -> Network:
        draw = np.random.default_rng(seed)
        vectors = []
        for size, odds in zip(SIZES, log_odds, strict=True):
            part = draw.normal(0, 0.1, (BUCKETS, size)).astype(np.float32)
            part[:, 0] = odds
            vectors.append(part)
        size, h = sum(SIZES), HIDDEN
        weights = {"attend": draw.normal(0, 0.3, (2 * h, ATTENTION)), "focus": draw.normal(0, 0.3, ATTENTION), "out": draw.normal(0, 0.3, 2 * h), "bias": np.zeros(1)}
        for way in "fb":
            weights[f"x{way}"] = draw.normal(0, 0.3, (size, 3 * h))
            weights[f"h{way}"] = draw.normal(0, 0.3, (h, 3 * h))
            weights[f"c{way}"] = np.zeros(3 * h)
        return cls(vectors, {k: v.astype(np.float32) for k, v in weights.items()})

    def inputs(self, f: Features) -> np.ndarray:
        word, prefix, gram = self.vectors
        if not len(f.word):
            return np.zeros((0, sum(SIZES)), np.float32)
        mean = np.add.reduceat(gram[f.gram], f.gram_bounds[:-1], axis=0) / np.diff(f.gram_bounds)[:, None]
        return np.concatenate([word[f.word], prefix[f.prefix], mean], axis=1)

    def layer(self, way: str, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """States (time, window, h) of one direction; with ``keep`` also what learning needs."""
        h, w, time = HIDDEN, self.weights[f"h{way}"], range(len(x))
        state = np.zeros((x.shape[1], h), np.float32)
        states, kept = np.zeros((len(x), x.shape[1], h), np.float32), []
        for t in time if way == "f" else reversed(time):
            u = state @ w
            gates = sigmoid(x[t, :, : 2 * h] + u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            n = np.tanh(x[t, :, 2 * h :] + r * u[:, 2 * h :])
            new = np.where(mask[t][:, None], (1 - z) * n + z * state, state)
            if keep:
                kept.append((t, state, z, r, n, u[:, 2 * h :]))
            states[t] = state = new
        return states, kept

    def pool(self, states: np.ndarray, mask: np.ndarray):
        """(logits, attention weights, pooled states, inner attention) of windows."""
        inner = np.tanh(states @ self.weights["attend"])
        score = np.where(mask, inner @ self.weights["focus"], -1e9)
        share = np.exp(score - score.max(0))
        share /= share.sum(0)
        pooled = (share[:, :, None] * states).sum(0)
        return pooled @ self.weights["out"] + self.weights["bias"], share, pooled, inner

    def score_windows(self, x: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Logits of the windows over word inputs ``x``."""
        gates = {way: (x @ self.weights[f"x{way}"] + self.weights[f"c{way}"]).astype(np.float32) for way in "fb"}
        out = np.zeros(len(first), np.float32)
        for low in range(0, len(first), TOGETHER):
            a, n = first[low : low + TOGETHER], size[low : low + TOGETHER]
            mask = np.arange(n.max())[:, None] < n
            at = np.minimum(a + np.arange(n.max())[:, None], len(x) - 1)
            states = np.concatenate([self.layer(way, gates[way][at], mask)[0] for way in "fb"], axis=2)
            out[low : low + TOGETHER] = self.pool(states, mask)[0]
        return out

    def score_texts(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Worst logit of each text (-inf without words), and that window's first word and size."""
        text, first, size = f.windows()
        best, where = np.full(len(f.bounds) - 1, -np.inf), np.zeros(len(f.bounds) - 1, np.int64)
        if len(text):
            logits = self.score_windows(self.inputs(f), first, size)
            order = np.lexsort((logits, text))
            last = order[np.append(np.flatnonzero(np.diff(text[order])), len(order) - 1)]
            best[text[last]], where[text[last]] = logits[last], last
        return best, (first[where] if len(first) else where), (size[where] if len(size) else where)

    def probability(self, logit: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return np.where(np.isfinite(logit), sigmoid(a * np.where(np.isfinite(logit), logit, 0) + b), 0.0)

    def learn(self, f: Features, first: np.ndarray, size: np.ndarray, label: np.ndarray, weight: np.ndarray, memory: dict, rate: float) -> float:
        """One step on windows; returns the loss."""
        h, grads = HIDDEN, {}
        mask = np.arange(WIDTH)[:, None] < size
        at = np.minimum(first + np.arange(WIDTH)[:, None], len(f.word) - 1)
        flat = at.ravel()
        n = np.diff(f.gram_bounds)[flat]
        begin = np.cumsum(n) - n
        grams = f.gram[np.repeat(f.gram_bounds[flat] - begin, n) + np.arange(n.sum())]
        word, prefix, gram = self.vectors
        mean = np.add.reduceat(gram[grams], begin, axis=0) / n[:, None]
        x = np.concatenate([word[f.word[flat]], prefix[f.prefix[flat]], mean], axis=1).reshape(WIDTH, len(first), -1)
        layers = {way: self.layer(way, x @ self.weights[f"x{way}"] + self.weights[f"c{way}"], mask, True) for way in "fb"}
        states = np.concatenate([layers["f"][0], layers["b"][0]], axis=2)
        logit, share, pooled, inner = self.pool(states, mask)
        p = sigmoid(logit)
        error = (p - label) * weight / weight.sum()
        grads["out"], grads["bias"] = pooled.T @ error, error.sum(keepdims=True)
        d_pooled = error[:, None] * self.weights["out"]
        d_share = (states * d_pooled).sum(2)
        d_score = share * (d_share - (share * d_share).sum(0))
        grads["focus"] = np.tensordot(d_score, inner, axes=([0, 1], [0, 1]))
        d_inner = d_score[:, :, None] * self.weights["focus"] * (1 - inner**2)
        grads["attend"] = np.tensordot(states, d_inner, axes=([0, 1], [0, 1]))
        d_states = share[:, :, None] * d_pooled + d_inner @ self.weights["attend"].T
        d_x = np.zeros_like(x)
        for i, way in enumerate("fb"):
            w, back = self.weights[f"h{way}"], np.zeros((len(first), h), np.float32)
            d_gates, grads[f"h{way}"] = np.zeros((WIDTH, len(first), 3 * h), np.float32), np.zeros_like(w)
            for t, before, z, r, new, u in reversed(layers[way][1]):
                d = d_states[t, :, i * h : (i + 1) * h] + back
                m = mask[t][:, None]
                skip, d = np.where(m, 0, d), np.where(m, d, 0)
                d_new = d * (1 - z) * (1 - new**2)
                d_gates[t] = np.concatenate([d * (before - new) * z * (1 - z), d_new * u * r * (1 - r), d_new], axis=1)
                d_u = np.concatenate([d_gates[t, :, : 2 * h], d_new * r], axis=1)
                grads[f"h{way}"] += before.T @ d_u
                back = skip + d * z + d_u @ w.T
            grads[f"x{way}"] = np.tensordot(x, d_gates, axes=([0, 1], [0, 1]))
            grads[f"c{way}"] = d_gates.sum((0, 1))
            d_x += d_gates @ self.weights[f"x{way}"].T
        memory["step"] = step = memory.get("step", 0) + 1
        for name, g in grads.items():
            m, v = memory.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            memory[name] = (m, v)
            self.weights[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        # the vectors move by plain gradient steps
        d_x = d_x.reshape(len(flat), -1)
        cuts = np.cumsum(SIZES)[:-1]
        d_word, d_prefix, d_mean = np.split(d_x, cuts, axis=1)
        d_gram = np.repeat(d_mean / n[:, None], n, axis=0)
        for part, rows, g in zip(self.vectors, (f.word[flat], f.prefix[flat], grams), (d_word, d_prefix, d_gram), strict=True):
            for k in range(g.shape[1]):
                part[:, k] -= (10 * rate) * np.bincount(rows, g[:, k], BUCKETS).astype(np.float32)
        return float(-(weight * np.log(np.where(label > 0, p, 1 - p) + 1e-9)).sum() / weight.sum())


def _pieces(texts: list[str], label: np.ndarray) -> Iterator[tuple[Features, np.ndarray]]:
    """Features and labels of the texts, a few at a time."""
    done = 0
    for low, high, data, offsets in words.texts(pa.array(texts, pa.large_string())):
        done = high
        yield Features.of(data, offsets), label[low:high]
    assert done == len(texts)


def _log_odds(pieces: Iterator[tuple[Features, np.ndarray]]) -> list[np.ndarray]:
    """Shrunken log-odds of a text being labelled, for each bucket of each kind."""
    with_, without, texts = np.zeros((3, BUCKETS)), np.zeros((3, BUCKETS)), np.zeros(2)
    for f, label in pieces:
        text = words.owners(f.bounds)
        texts += [label.sum(), (1 - label).sum()]
        kinds = ((f.word, text), (f.prefix, text), (f.gram, np.repeat(text, np.diff(f.gram_bounds))))
        for i, (bucket, owner) in enumerate(kinds):
            pair = np.unique(owner.astype(np.int64) * BUCKETS + bucket)
            bucket, y = pair % BUCKETS, label[pair // BUCKETS]
            with_[i] += np.bincount(bucket, y, BUCKETS)
            without[i] += np.bincount(bucket, 1 - y, BUCKETS)
    odds = np.log((with_ + 0.5) / (texts[0] + 1)) - np.log((without + 0.5) / (texts[1] + 1))
    seen = with_ + without
    return list((np.clip(odds, -3, 6) * seen / (seen + 8)).astype(np.float32))


def _first_guess(net: Network, f: Features) -> tuple[np.ndarray, np.ndarray]:
    """For each text the window with the largest sum of word and prefix log-odds: first word and size."""
    odds = np.append(0, np.cumsum(net.vectors[0][f.word, 0] + net.vectors[1][f.prefix, 0]))
    text, first, size = f.windows()
    at, n = np.zeros(len(f.bounds) - 1, np.int64), np.zeros(len(f.bounds) - 1, np.int64)
    if len(text):
        order = np.lexsort((odds[first + size] - odds[first], text))
        last = order[np.append(np.flatnonzero(np.diff(text[order])), len(order) - 1)]
        at[text[last]], n[text[last]] = first[last], size[last]
    return at, n


def fit(texts: list[str], label: np.ndarray, prior: float, seed: int = 11, rounds: int = 4, batch: int = 256) -> Network:
    """Network from labelled texts; ``prior`` is the share of label 1 that the scale is set to."""
    fifth = np.arange(len(texts)) % 5

    def part(*numbers: int) -> Iterator[tuple[Features, np.ndarray]]:
        mine = np.flatnonzero(np.isin(fifth, numbers))
        return _pieces([texts[i] for i in mine], label[mine])

    net = Network.fresh(_log_odds(part(0, 1)), seed)
    draw, memory, pieces = np.random.default_rng(seed), {}, list(part(2, 3))
    positive = sum(y.sum() for _, y in pieces)
    total = sum(len(y) for _, y in pieces)
    for number in range(rounds):
        for k in draw.permutation(len(pieces)):
            f, y = pieces[k]
            if number:
                _, at, n = net.score_texts(f)
            else:
                at, n = _first_guess(net, f)
            text, first, size = f.windows()
            weight = np.where(y > 0, 0.5 / max(positive, 1), 0.5 / max(total - positive, 1)) * total
            # other windows of texts without the label are examples too
            other = draw.permutation(np.flatnonzero(y[text] == 0))[: len(y)]
            used = np.flatnonzero(n > 0)
            a, m = np.append(at[used], first[other]), np.append(n[used], size[other])
            t, w = np.append(y[used], y[text[other]]), np.append(weight[used], 0.5 * weight[text[other]])
            for _ in range(3):
                mixed = draw.permutation(len(a))
                for low in range(0, len(a), batch):
                    pick = mixed[low : low + batch]
                    net.learn(f, a[pick], m[pick], t[pick], w[pick], memory, 0.01 / (1 + number))
    # two numbers that map the worst logit to a probability, by Newton's method
    scored = [(net.score_texts(f)[0], y) for f, y in part(4)]
    logit, y = (np.concatenate(x) for x in zip(*scored, strict=True)) if scored else (np.zeros(0), np.zeros(0))
    keep = np.isfinite(logit)
    logit, y = logit[keep], y[keep]
    if len(y) and 0 < y.sum() < len(y):
        w = np.where(y > 0, prior / y.mean(), (1 - prior) / (1 - y.mean()))
        x, theta = np.stack([logit, np.ones(len(logit))], 1), np.array([1.0, 0.0])
        for _ in range(30):
            p = sigmoid(x @ theta)
            grad = x.T @ (w * (p - y)) + 0.01 * (theta - [1.0, 0.0])
            theta -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), grad)
        net.scale = (float(theta[0]), float(theta[1]))
    return net


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", rows_per_label: int = 4000, most_bytes: int = 100_000
) -> Network:
    """Network fitted on about ``rows_per_label`` labelled texts of each label, chosen by a seeded hash.

    Only labels of training rows are read. Texts above ``most_bytes`` are not fitted on (they are scored whole). A
    document with several labels counts as the largest; null labels are no labels. Without both labels every text
    scores 0.
    """
    mine = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"))
    mine = mine.where(training_row(F.col("key")) & F.col("label").isNotNull()).groupBy("key").agg(F.max("label").alias("label"))
    counts = dict(mine.where("label IN (0, 1)").groupBy("label").count().collect())
    if len(counts) < 2:
        return None
    span = 1 << 30
    limit = F.when(F.col("label") == 1, int(span * min(1, rows_per_label / counts[1]))).when(
        F.col("label") == 0, int(span * min(1, rows_per_label / counts[0]))
    )
    draw = F.pmod(F.xxhash64(F.lit("toxic"), "key"), F.lit(span))
    # bounded by the sample size
    chosen = F.broadcast(mine.withColumn("draw", draw).where(F.col("draw") < limit))
    content = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    sample = content.join(chosen, "key").where(F.octet_length("text") <= most_bytes)
    rows = sample.groupBy("text").agg(F.max("label").alias("label"), F.min("draw").alias("draw")).collect()
    rows.sort(key=lambda r: (r["draw"], r["text"]))
    return fit([r["text"] for r in rows], np.array([r["label"] for r in rows], float), counts[1] / (counts[0] + counts[1]))


def _scorer(trained):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network | None = trained()
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if net is not None:
                for low, high, data, offsets in words.texts(batch.column(0)):
                    out[low:high] = net.probability(net.score_texts(Features.of(data, offsets))[0])
            yield pa.RecordBatch.from_arrays([pa.array(out), batch.column(1)], ["score", "record"])

    return score


def score(docs: DataFrame, network: Network | None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(score, record) of every whole text of ``docs``: null texts and texts without words score 0.

    ``record`` holds the columns ``carry`` (default all), so names cannot clash; repeated rows get equal scores.
    """
    record = F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)]).alias("record")
    rows = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), record)
    kind = rows.schema["record"].dataType.simpleString()
    return rows.mapInArrow(_scorer(shared(docs.sparkSession, network)), f"score double, record {kind}")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")), carry=["doc_id"])
    key = F.col("record.doc_id")
    return found.select(key.alias("doc_id"), (~training_row(key)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
SQL: dict[str, str] = {}
