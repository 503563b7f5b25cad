"""Language identification by a linear-chain conditional random field over words.

Each word is a position of the chain. Its features are affixes (character n-grams that touch a word's edge), inner
n-grams, and membership in each language's lexicon (its frequent words in the sample); transitions between languages
are learned, so that code-switched text is labelled word by word by forward-backward. The training chains are spliced
from stretches of documents of different languages, which shows the model what a switch looks like.

A document's language is the one with the largest share of its words' posterior mass; that share is the score.

Defined results: null text, empty text and text without a letter get ``und`` with score 0. Ties go to the language that
sorts first. Where no row is labelled, every document gets ``und``. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_bucket, map_arrow, pieces
from .words import Buffer, letters_only

#: Slots of the hashed n-gram weights, and the n-gram sizes in bytes (the blank at an edge counts).
SLOTS, SIZES = 1 << 16, (2, 3, 4, 5)
#: Slots of the lexicon; every word that a language's sample has more than once is in it.
LEXICON_SLOTS = 1 << 20
#: Bound of the fitting sample: documents of each language, whole. More languages than MOST_LANGUAGES are refused.
SAMPLE_DOCS, MOST_LANGUAGES = 150, 1000
#: Words up to which the sample is gone through ROUNDS times; of a longer one every word is still used once at least.
ROUNDS, ROUND_WORDS = 6, 150_000
UNKNOWN = "und"
#: Words whose chains are run together.
CHAIN_WORDS = 1_500_000


@dataclass
class Model:
    languages: list[str]
    weight: np.ndarray  # (SLOTS, L): n-grams
    lexicon: np.ndarray  # (LEXICON_SLOTS, L / 64): bit l set where language l knows the word
    member: np.ndarray  # (L, L): weight for label m of being in language l's lexicon
    transition: np.ndarray  # (L, L): from, to
    start: np.ndarray  # (L,)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """(words, L) of 0 and 1: the lexicons that have each word."""
        bits, label = self.lexicon[(hashes % np.uint64(LEXICON_SLOTS)).astype(np.int64)], np.arange(len(self.languages))
        return ((bits[:, label // 64] >> (label % 64).astype(np.uint64)) & np.uint64(1)).astype(np.float32)

    def emissions(self, buffer: Buffer) -> np.ndarray:
        """(words, L) scores; the mean of a word's n-gram weights keeps long words from dominating."""
        out = self.known(buffer.word_hash()) @ self.member
        scale = (1.0 / np.sqrt(buffer.end - buffer.start + 1.0)).astype(np.float32)[:, None]
        for size in SIZES:
            out += buffer.per_word(self.weight[buffer.grams(size, SLOTS)]) * scale
        return out


def chains(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each step, the number of chains still running, longest first, and their positions."""
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    sorted_lengths = -lengths[order]
    for step in range(int(lengths.max(initial=0))):
        running = int(np.searchsorted(sorted_lengths, -step, side="left"))
        yield running, first[:running] + step


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each label at each position, expected transitions summed, and the log-likelihood's normaliser."""
    top = scores.max(axis=1, keepdims=True) if len(scores) else scores
    local, step = np.exp(scores - top), np.exp(transition).astype(scores.dtype)
    alpha, norm = np.zeros_like(local), np.ones(len(local))
    plan = list(chains(lengths))
    state = None
    for t, (running, at) in enumerate(plan):
        state = (np.exp(start).astype(scores.dtype) if t == 0 else state[:running] @ step) * local[at]
        norm[at] = total = state.sum(1)
        state = state / total[:, None]
        alpha[at] = state
    labels, beta = scores.shape[1], None
    posterior, expected = np.zeros_like(local), np.zeros((labels, labels))
    later = 0
    for t in range(len(plan) - 1, -1, -1):
        running, at = plan[t]
        grown = np.ones((running, labels), scores.dtype)
        if later:
            onward = local[plan[t + 1][1]] * beta / norm[plan[t + 1][1]][:, None].astype(scores.dtype)
            grown[:later] = onward @ step.T
            if pairs:
                expected += np.einsum("ni,nj->ij", alpha[at[:later]], onward) * step
        beta, later = grown, running
        posterior[at] = alpha[at] * beta
    posterior /= np.maximum(posterior.sum(1, keepdims=True), 1e-30)
    return posterior, expected, float(np.log(norm).sum() + top.sum())


def sample(docs: DataFrame, label: str, docs_a_label: int, seed: int) -> dict[str, list[str]]:
    """At most ``docs_a_label`` texts of each label, chosen by a hash of the row; the bound is this parameter.

    A label's count sets the share of its rows that comes to the driver, so no label is sorted or gathered whole.
    """
    counts = {r[label]: r["n"] for r in docs.groupBy(label).agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if not counts:
        return {}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*(F.when(F.col(label) == k, F.lit(min(1.0, 2.0 * docs_a_label / n))) for k, n in counts.items()))
    # rows that repeat both id and text count once, so that the share bounds what comes
    rows = docs.where(place < share).groupBy(F.col(label).alias("label"), place.alias("place")).agg(F.min("text").alias("text")).collect()
    out: dict[str, list[str]] = {k: [] for k in sorted(counts)}
    for row in sorted(rows, key=lambda r: (r["place"], r["text"])):
        if len(out[row["label"]]) < docs_a_label:
            out[row["label"]].append(row["text"])
    return out


def fit(texts: dict[str, list[str]], seed: int = 7, rounds: int = ROUNDS) -> Model:
    """Maximise the conditional likelihood of spliced chains by AdaGrad on seeded mini-batches."""
    rng = np.random.default_rng(seed)
    languages = sorted(texts)
    count = len(languages)
    stretches: list[tuple[int, list[str]]] = []
    frequent: list[dict[str, int]] = [{} for _ in languages]
    for k, language in enumerate(languages):
        for text in texts[language]:
            words, at = letters_only(text).split(), 0
            for word in words:
                frequent[k][word] = frequent[k].get(word, 0) + 1
            while at < len(words):
                cut = int(rng.integers(4, 40))
                stretches.append((k, words[at : at + cut]))
                at += cut
    model = Model(languages, np.zeros((SLOTS, count), np.float32), np.zeros((LEXICON_SLOTS, -(-count // 64)), np.uint64), np.zeros((count, count), np.float32), np.zeros((count, count), np.float32), np.zeros(count, np.float32))
    for k, words in enumerate(frequent):
        best = sorted(w for w, n in words.items() if n > 1)
        if best:
            slots = (Buffer([" ".join(best)]).word_hash() % np.uint64(LEXICON_SLOTS)).astype(np.int64)
            model.lexicon[slots, k // 64] |= np.uint64(1) << np.uint64(k % 64)
    if count < 2 or not stretches:
        return model
    order = rng.permutation(len(stretches))
    spliced = [[stretches[i] for i in order[a : a + 3]] for a in range(0, len(order), 3)]
    parts = [model.weight, model.member, model.transition, model.start]
    squares = [np.full_like(p, 1e-6) for p in parts]
    every = sum(len(words) for _, words in stretches)
    for _ in range(max(1, min(rounds, rounds * ROUND_WORDS // every))):
        for a in range(0, len(spliced), 48):
            batch = spliced[a : a + 48]
            buffer = Buffer([" ".join(w for _, words in chain for w in words) for chain in batch])
            truth = np.array([k for chain in batch for k, words in chain for _ in words])
            scores = model.emissions(buffer).astype(np.float64)
            posterior, expected, _ = forward_backward(scores, buffer.words, model.transition, model.start, pairs=True)
            error = np.zeros_like(posterior)
            error[np.arange(len(truth)), truth] = 1
            first = np.cumsum(buffer.words) - buffer.words
            gradient_start = (error - posterior)[first].sum(0)
            error -= posterior
            inner = np.ones(len(truth), bool)
            inner[first] = False
            seen = np.zeros((count, count))
            np.add.at(seen, (truth[:-1][inner[1:]], truth[1:][inner[1:]]), 1)
            gradient = np.zeros((SLOTS, count))
            spread = error / np.sqrt(buffer.end - buffer.start + 1.0)[:, None]
            owner = np.clip(np.searchsorted(buffer.start - 1, np.arange(len(buffer.bytes)), side="right") - 1, 0, None)
            for size in SIZES:
                slots = buffer.grams(size, SLOTS)
                for k in range(count):
                    gradient[:, k] += np.bincount(slots, weights=spread[owner, k], minlength=SLOTS)
            gradient[0] = 0
            for part, square, g in zip(parts, squares, [gradient, model.known(buffer.word_hash()).T @ error, seen - expected, gradient_start]):
                g = g / len(batch) - 1e-4 * part
                square += g * g
                part += (0.25 * g / np.sqrt(square)).astype(np.float32)
    return model


def label_words(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each language for each word of each whole text (see letters_only), and the words of each text."""
    scores, words = [], []
    at = 0
    while at < len(texts):
        size, first = 0, at
        while at < len(texts) and (at == first or size + len(texts[at]) < 1 << 20):
            size, at = size + len(texts[at]), at + 1
        buffer = Buffer(texts[first:at])
        once, inverse = buffer.distinct()
        scores.append(model.emissions(once)[inverse])
        words.append(buffer.words)
    lengths = np.concatenate(words) if words else np.zeros(0, np.int64)
    scores = np.concatenate(scores) if scores else np.zeros((0, len(model.languages)), np.float32)
    return forward_backward(scores, lengths, model.transition, model.start)[0], lengths


def score(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    clean = [letters_only(t) for t in texts]
    mass = np.zeros((len(texts), max(1, len(model.languages))))
    if model.languages:
        posterior, lengths = label_words(model, clean)
        has = np.flatnonzero(lengths)
        if len(has):
            mass[has] = np.add.reduceat(posterior, (np.cumsum(lengths) - lengths)[has], axis=0, dtype=np.float64) / lengths[has, None]
    best = mass.argmax(1)
    top = np.minimum(mass.max(1), 1.0)
    return [model.languages[k] if c and model.languages else UNKNOWN for k, c in zip(best, clean)], np.where([bool(c) for c in clean], top, 0.0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every whole text, beside all other columns of ``docs`` but the text's meaning."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, most=2 << 20):
            language, top = score(shared.value, part.column("text").to_pylist())
            kept = [n for n in part.schema.names if n not in ("lang_pred", "score")]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), pa.array(language, pa.string()), pa.array(top, pa.float64())], names=[*kept, "lang_pred", "score"])

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("lang_pred", "score"))
    return map_arrow(docs.drop("lang_pred", "score"), run, f"{given}, lang_pred string, score double")


def train(docs: DataFrame, docs_a_language: int = SAMPLE_DOCS, seed: int = 7) -> Model:
    """Fit on a bounded sample of rows of ``doc_id, text, lang`` with neither text nor lang null."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    return fit(sample(rows, "lang", docs_a_language, seed), seed)


def held_out_prediction(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from documents that are not held out (crc32 of the id mod 4 is 2)."""
    held = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    model = train(docs.where(~held))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def _with_letters(docs: DataFrame) -> DataFrame:
    """The documents that have a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, most=2 << 20):
            yield part.filter(pa.array([bool(letters_only(t)) for t in part.column("text").to_pylist()], pa.bool_()))

    return map_arrow(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The documents whose words mostly belong to one language; without a letter, or with a score under ``least``, they go.

    Where nothing can be learned (no row has both a text and a language), those with a letter stay.
    """
    model = train(docs)
    if not model.languages:
        return _with_letters(docs)
    marked = predict(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return marked.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
