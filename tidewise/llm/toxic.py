"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is its own hashed embedding beside the scaled sum of its hashed character n-gram embeddings, so that
unseen forms of known words are read by their characters. Windows of ``WINDOW`` words overlap by half and cover the whole text; in
each a forward and a backward gated unit run, an attention layer pools their states, and a logistic unit scores the pool. A
document's score is that of its worst window, calibrated on documents kept apart from the gradient steps.

Labels are of documents, so training alternates: windows are scored, the worst windows of toxic documents count as toxic and
the worst and some random windows of clean ones as clean, then Adam steps follow. The first choice is made by
the log-odds of n-grams between the two classes.

Defined results: null and empty texts, and texts without a letter, get the share of toxic rows in the sample (0.0 if that
share isn't below 0.5, so they are never predicted toxic); without labels of both classes every document gets that share. An
id that is labelled both ways isn't learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_bucket, map_arrow, pieces
from .words import Buffer, letters_only

WINDOW, STRIDE = 48, 24
WORD_SLOTS, GRAM_SLOTS, SIZES = 1 << 14, 1 << 15, (3, 4)
WORD_SIZE, GRAM_SIZE, HIDDEN, ATTENTION = 8, 16, 8, 8
#: Bound of the fitting sample: documents of each class.
SAMPLE_DOCS = 700
ROUNDS, BATCH, LEAST_STEPS, MOST_ROUNDS = 6, 96, 240, 40
#: Windows run together: their states stay in the processor's cache.
LANES = 4096


class Words:
    """Slots of the words of texts and of their character n-grams."""

    def __init__(self, buffer: Buffer):
        self.buffer = buffer
        self.slot = (self.buffer.word_hash() % np.uint64(WORD_SLOTS - 1)).astype(np.int64) + 1
        self.grams = [self.buffer.grams(size, GRAM_SLOTS) for size in SIZES]
        self.scale = (1.0 / np.sqrt(self.buffer.end - self.buffer.start + 1.0)).astype(np.float32)


def windows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with so many words: the owner, first word and length of each window."""
    count = np.where(words <= WINDOW, (words > 0).astype(np.int64), 1 + -(-(words - WINDOW) // STRIDE))
    owner = np.repeat(np.arange(len(words)), count)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    within = np.minimum(turn * STRIDE, np.maximum(words[owner] - WINDOW, 0))
    return owner, (np.cumsum(words) - words)[owner] + within, np.minimum(words[owner], WINDOW)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Net:
    parts: dict[str, np.ndarray] = field(default_factory=dict)
    share: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    @classmethod
    def fresh(cls, seed: int) -> Net:
        rng = np.random.default_rng(seed)
        inputs = WORD_SIZE + GRAM_SIZE
        shapes = {"word": (WORD_SLOTS, WORD_SIZE), "gram": (GRAM_SLOTS, GRAM_SIZE), "att": (2 * HIDDEN, ATTENTION), "att_v": (ATTENTION,), "out": (2 * HIDDEN,)}
        for way in "fb":
            shapes |= {f"in_{way}": (inputs, 3 * HIDDEN), f"re_{way}": (HIDDEN, 3 * HIDDEN)}
        parts = {k: (rng.normal(size=s) * (0.1 if k in ("word", "gram") else 1 / np.sqrt(s[0]))).astype(np.float32) for k, s in shapes.items()}
        parts |= {"bias_f": np.zeros(3 * HIDDEN, np.float32), "bias_b": np.zeros(3 * HIDDEN, np.float32), "att_0": np.zeros(ATTENTION, np.float32), "out_0": np.zeros(1, np.float32)}
        parts["word"][0] = parts["gram"][0] = 0
        return cls(parts)

    def inputs(self, words: Words) -> np.ndarray:
        """(words, inputs) of a whole buffer."""
        grams = sum(words.buffer.per_word(self.parts["gram"][g]) for g in words.grams) * words.scale[:, None]
        return np.concatenate([self.parts["word"][words.slot], grams], axis=1)

    def states(self, projected: np.ndarray, mask: np.ndarray | None, way: str, trace: list | None = None) -> np.ndarray:
        """(steps, lanes, HIDDEN) states of one direction; projected: (steps, lanes, 3 * HIDDEN)."""
        recur, steps = self.parts[f"re_{way}"], projected.shape[0]
        out = np.empty((steps, projected.shape[1], HIDDEN), np.float32)
        h = np.zeros((projected.shape[1], HIDDEN), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            g, p = h @ recur, projected[t]
            gates = 1.0 / (1.0 + np.exp(-(p[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])))
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(p[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if mask is not None:
                new = h + mask[t][:, None] * (new - h)
            if trace is not None:
                trace.append((t, h, g, z, r, n))
            out[t] = h = new
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, ...]:
        e = np.tanh(states @ self.parts["att"] + self.parts["att_0"])
        s = e @ self.parts["att_v"]
        if mask is not None:
            s = np.where(mask > 0, s, -1e9)
        w = np.exp(s - s.max(0))
        w /= w.sum(0)
        c = np.einsum("tb,tbh->bh", w, states)
        return e, w, c, c @ self.parts["out"] + self.parts["out_0"][0]

    def window_logits(self, buffer: Buffer, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The logit of each window of a buffer; what depends on a word alone is worked out once for each different word."""
        once, inverse = buffer.distinct()
        x = self.inputs(Words(once))
        projected = {way: x @ self.parts[f"in_{way}"] + self.parts[f"bias_{way}"] for way in "fb"}
        out = np.zeros(len(first), np.float32)
        order = np.argsort(-length, kind="stable")
        for at in range(0, len(order), LANES):
            lane = order[at : at + LANES]
            steps = int(length[lane[0]])
            index = inverse[np.minimum(first[lane] + np.arange(steps)[:, None], len(inverse) - 1)]
            mask = None if length[lane[-1]] == steps else (np.arange(steps)[:, None] < length[lane]).astype(np.float32)
            states = np.concatenate([self.states(projected[way][index], mask, way) for way in "fb"], axis=2)
            out[lane] = self.pool(states, mask)[3]
        return out

    def gradients(self, words: Words, first: np.ndarray, length: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log-loss over some windows."""
        p, steps, lanes = self.parts, int(length.max()), len(first)
        index = np.minimum(first + np.arange(steps)[:, None], len(words.slot) - 1)
        mask = (np.arange(steps)[:, None] < length).astype(np.float32)
        used, compact = np.unique(index, return_inverse=True)
        compact = compact.reshape(index.shape)
        start, end = words.buffer.start[used] - 1, words.buffer.end[used]
        span = end - start
        edge = np.cumsum(span) - span
        place = np.repeat(start - edge, span) + np.arange(int(span.sum()))
        gram_slots = [g[place] for g in words.grams]
        gram_sum = sum(np.add.reduceat(p["gram"][g], edge, axis=0) for g in gram_slots) * words.scale[used, None]
        x = np.concatenate([p["word"][words.slot[used]], gram_sum], axis=1)[compact]
        traces: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.states(x @ p[f"in_{way}"] + p[f"bias_{way}"], mask, way, traces[way]) for way in "fb"], axis=2)
        e, w, c, logit = self.pool(states, mask)
        error = ((sigmoid(logit) - truth) / lanes).astype(np.float32)
        grad = {"out": c.T @ error, "out_0": np.array([error.sum()], np.float32)}
        d_c = error[:, None] * p["out"]
        d_w = np.einsum("bh,tbh->tb", d_c, states)
        d_states = w[:, :, None] * d_c
        d_s = w * (d_w - (w * d_w).sum(0))
        d_pre = d_s[:, :, None] * p["att_v"] * (1 - e * e)
        grad |= {"att_v": np.einsum("tba,tb->a", e, d_s), "att": np.einsum("tbh,tba->ha", states, d_pre), "att_0": d_pre.sum((0, 1))}
        d_states = d_states + d_pre @ p["att"].T
        d_x = np.zeros_like(x)
        for k, way in enumerate("fb"):
            recur, d_h = p[f"re_{way}"], np.zeros((lanes, HIDDEN), np.float32)
            d_projected, d_recur = np.zeros((steps, lanes, 3 * HIDDEN), np.float32), np.zeros_like(recur)
            for t, h, g, z, r, n in reversed(traces[way]):
                d_out = d_h + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                d_new = d_out * mask[t][:, None]
                d_n = d_new * (1 - z) * (1 - n * n)
                d_z = d_new * (h - n) * z * (1 - z)
                d_r = d_n * g[:, 2 * HIDDEN :] * r * (1 - r)
                d_projected[t] = np.concatenate([d_z, d_r, d_n], axis=1)
                d_g = np.concatenate([d_z, d_r, d_n * r], axis=1)
                d_recur += h.T @ d_g
                d_h = d_out - d_new + d_new * z + d_g @ recur.T
            grad |= {f"re_{way}": d_recur, f"in_{way}": np.einsum("tbi,tbg->ig", x, d_projected), f"bias_{way}": d_projected.sum((0, 1))}
            d_x += d_projected @ p[f"in_{way}"].T
        d_used = np.zeros((len(used), x.shape[2]), np.float32)
        np.add.at(d_used, compact.ravel(), d_x.reshape(-1, x.shape[2]))
        grad["word"] = np.zeros_like(p["word"])
        np.add.at(grad["word"], words.slot[used], d_used[:, :WORD_SIZE])
        grad["gram"] = np.zeros_like(p["gram"])
        spread = np.repeat(d_used[:, WORD_SIZE:] * words.scale[used, None], span, axis=0)
        for g in gram_slots:
            np.add.at(grad["gram"], g, spread)
        grad["gram"][0] = grad["word"][0] = 0
        return grad


def odds(words: Words, owner_words: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For each word the positive log-odds of its grams and itself between toxic and clean documents, the strongest of them."""
    doc = np.repeat(np.arange(len(owner_words)), owner_words)
    best = np.zeros(len(doc))
    byte_word = np.clip(np.searchsorted(words.buffer.start - 1, np.arange(len(words.buffer.bytes)), side="right") - 1, 0, None)
    for slots, owner, most in [(words.slot, np.arange(len(doc)), WORD_SLOTS), *((g, byte_word, GRAM_SLOTS) for g in words.grams)]:
        pair = np.unique(doc[owner] * most + slots)
        has, slot = pair // most, pair % most
        bad, good = np.bincount(slot[toxic[has]], minlength=most) + 1.0, np.bincount(slot[~toxic[has]], minlength=most) + 1.0
        ratio = np.log(bad / (toxic.sum() + 2.0)) - np.log(good / ((~toxic).sum() + 2.0))
        ratio[0] = 0
        np.maximum.at(best, owner, np.maximum(ratio[slots] - 0.7, 0))
    return best


def fit(clean: list[str], toxic: list[str], seed: int = 13) -> Net:
    """Train on texts of both classes (as letters_only gives them)."""
    rng = np.random.default_rng(seed)
    texts = [t for pair in zip(clean, toxic) for t in pair] + clean[len(toxic) :] + toxic[len(clean) :]
    truth = np.array([x for _ in zip(clean, toxic) for x in (0, 1)] + [0] * (len(clean) - len(toxic)) + [1] * (len(toxic) - len(clean)), bool)
    net = Net.fresh(seed)
    words = Words(Buffer(texts))
    owner, first, length = windows(words.buffer.words)
    apart = rng.random(len(texts)) < 0.2
    strength = np.concatenate([[0], np.cumsum(odds(words, words.buffer.words, truth & ~apart) if truth.any() else np.zeros(len(words.slot)))])
    score = strength[first + length] - strength[first]
    means = {k: np.zeros_like(v) for k, v in net.parts.items()}
    squares = {k: np.zeros_like(v) for k, v in net.parts.items()}
    step, turn = 0, 0
    while turn < ROUNDS or (step < LEAST_STEPS and turn < MOST_ROUNDS):
        order = np.lexsort((-score, owner))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        bad = truth[owner]
        chosen = np.flatnonzero(~apart[owner] & np.where(bad, rank < 2, (rank < 3) | (rng.random(len(rank)) < 0.06)))
        rng.shuffle(chosen)
        for at in range(0, len(chosen), BATCH):
            pick = chosen[at : at + BATCH]
            grad = net.gradients(words, first[pick], length[pick], bad[pick])
            step += 1
            rate = 0.01 * min(1.0, step / 20) * (0.5 if step > LEAST_STEPS else 1.0)
            for k, g in grad.items():
                means[k] += 0.1 * (g - means[k])
                squares[k] += 0.01 * (g * g - squares[k])
                net.parts[k] -= rate * (means[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.99**step)) + 1e-7)
        score, turn = net.window_logits(words.buffer, first, length), turn + 1
    worst = np.full(len(texts), -np.inf)
    np.maximum.at(worst, owner, score)
    fold = np.isfinite(worst) & (apart if (apart & truth).sum() > 10 and (apart & ~truth).sum() > 10 else np.ones(len(texts), bool))
    net.slope, net.offset = calibrated(worst[fold], truth[fold])
    return net


def calibrated(logit: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the logits (Newton steps, a weak pull to slope 1)."""
    slope, offset = 1.0, 0.0
    for _ in range(30):
        p = sigmoid(slope * logit + offset)
        w, e = p * (1 - p) + 1e-6, p - truth
        g = np.array([(e * logit).sum() + 0.5 * (slope - 1), e.sum() + 0.05 * offset])
        h = np.array([[(w * logit * logit).sum() + 0.5, (w * logit).sum()], [(w * logit).sum(), w.sum() + 0.05]])
        d = np.linalg.solve(h, g)
        slope, offset = slope - float(np.clip(d[0], -0.5, 0.5)), offset - float(np.clip(d[1], -1, 1))
    return max(slope, 0.05), offset


def score(net: Net, texts: list[str | None]) -> np.ndarray:
    """The score of each whole text: its worst window's."""
    out = np.full(len(texts), net.share if net.share < 0.5 else 0.0)
    if not net.parts:
        return out
    buffer = Buffer([letters_only(t) for t in texts])
    owner, first, length = windows(buffer.words)
    if len(owner):
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, owner, net.window_logits(buffer, first, length))
        has = np.isfinite(worst)
        out[has] = sigmoid(net.slope * worst[has] + net.offset)
    return out


def train(docs: DataFrame, labels: DataFrame, docs_a_class: int = SAMPLE_DOCS, seed: int = 13) -> Net:
    """Fit on a bounded sample of labelled documents (``labels``: doc_id, toxic), as many of each class as the bound allows."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
    known = known.where(F.col("toxic") == F.col("_most")).drop("_most")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return Net(share=share)
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.coalesce(*(F.when(F.col("toxic") == k, F.lit(min(1.0, 1.5 * docs_a_class / n))) for k, n in counts.items()))
    # at most a few thousand ids, by the share just computed and the limit
    ids = known.withColumn("place", place).where(F.col("place") < wanted).limit(8 * docs_a_class)
    # of an id on several rows the smallest text stands for it
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic", "place").agg(F.min("text").alias("text")).collect()
    chosen: dict[int, list[str]] = {0: [], 1: []}
    for row in sorted(rows, key=lambda r: (r["place"], r["text"])):
        if len(chosen[row["toxic"]]) < docs_a_class and (clean := letters_only(row["text"])):
            chosen[row["toxic"]].append(clean)
    if not chosen[0] or not chosen[1]:
        return Net(share=share)
    net = fit(chosen[0], chosen[1], seed)
    net.share = share
    return net


def predict(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, most=2 << 20):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score(shared.value, part.column("text").to_pylist()).astype(np.float64))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labels of rows that are not held out (crc32 of the id mod 5 is 0)."""
    held = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))
    net = train(docs.where(~held), labels.where(~held))
    return predict(docs, net).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
