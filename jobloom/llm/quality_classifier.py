"""Operator 13: a quality classifier learned from positive and unlabelled texts.

Trusted positives are documents labelled good; all texts, whatever their label, are the unlabelled web text.
The share of good documents among them is estimated first: a classifier of positives against unlabelled
texts ranks a second half of the sample, and the smallest ratio of both halves' upper tails (with an
allowance for small counts) is the class prior. A linear model then minimises the non-negative unbiased
risk: the positives' loss weighted by the prior, plus the unlabelled texts' loss as negatives less what
the positives among them cost, a difference that is kept from falling below zero.

A text's features are bounded in number and made on the executors: measures of its style, frequencies of
runs of three byte classes, and of hashed words. Scoring is one pass, with one weight looked up per feature.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: Byte classes: blank, line break, small, capital, digit, punctuation, sign, beyond ASCII.
KINDS = np.full(256, 6, np.uint8)
KINDS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 0
KINDS[0x0A] = 1
KINDS[ord("a"):ord("z") + 1] = 2
KINDS[ord("A"):ord("Z") + 1] = 3
KINDS[ord("0"):ord("9") + 1] = 4
KINDS[list(b".,;:!?'\"()-")] = 5
KINDS[128:] = 7
STYLE = 14
RUNS = 8 ** 3
WORDS = 1 << 15
WIDTH = STYLE + RUNS + WORDS
#: What a share or a frequency counts for.
WEIGHT = 10.0

#: Texts of the sample that must have a hashed feature for it to be learned.
LEAST_TEXTS = 5


class Features(NamedTuple):
    """Style of every text, and frequencies as (row, slot, value), a slot possibly more than once."""

    style: np.ndarray
    row: np.ndarray
    slot: np.ndarray
    value: np.ndarray


def features(texts: pa.Array) -> Features:
    """Of whole texts; a null text is empty."""
    offsets, data = common.utf8(texts)
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    kinds = KINDS[data]
    of = np.repeat(np.arange(rows, dtype=np.int32), sizes)
    starts, ends, word_row = common.word_spans(offsets, data)
    words = np.bincount(word_row, minlength=rows)
    prints = common.Spans(common.lowered(data)).of(starts, ends)

    def share(mask: np.ndarray, at: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.bincount(at[mask], minlength=rows) / np.maximum(whole, 1)

    same = np.zeros(len(prints), bool)
    same[1:] = (prints[1:] == prints[:-1]) & (word_row[1:] == word_row[:-1])
    distinct = np.unique(common.mixed(prints + word_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    small, capital = (np.bincount(of[kinds == k], minlength=rows) for k in (2, 3))
    lines = np.bincount(of[kinds == 1], minlength=rows)
    style = np.zeros((rows, STYLE))
    style[:, 0] = 1
    style[:, 1] = np.log1p(words) / 5
    style[:, 2] = np.minimum(np.bincount(word_row, weights=ends - starts, minlength=rows) / np.maximum(words, 1), 40) / 10
    style[:, 3] = capital / np.maximum(small + capital, 1)
    for i, k in enumerate((4, 5, 6, 7)):
        style[:, 4 + i] = share(kinds == k, of, sizes)
    style[:, 8] = share(same, word_row, words)
    style[:, 9] = np.bincount(word_row[distinct], minlength=rows) / np.maximum(words, 1)
    style[:, 10] = np.minimum(lines / np.maximum(words, 1), 1)
    style[:, 11] = share(kinds[ends - 1] == 6, word_row, words)
    style[:, 12] = share(data[ends - 1] == ord("!"), word_row, words)
    style[:, 13] = words == 0
    style[:, 3:13] *= WEIGHT
    code = (kinds[:-2].astype(np.int32) * 8 + kinds[1:-1]) * 8 + kinds[2:] if len(kinds) > 2 else np.zeros(0, np.int32)
    inside = of[:len(code)] == of[2:] if len(code) else np.zeros(0, bool)
    run_row, code = of[:len(code)][inside], code[inside]
    slots = (prints >> np.uint64(64 - 15)).astype(np.int32)
    return Features(
        style, np.concatenate([run_row, word_row]).astype(np.int32), np.concatenate([STYLE + code, STYLE + RUNS + slots]),
        np.concatenate([WEIGHT / np.maximum(sizes - 2, 1)[run_row], WEIGHT / np.maximum(words, 1)[word_row]]))


# ---------------------------------------------------------------------------
# Learning
# ---------------------------------------------------------------------------


class Sample(NamedTuple):
    """Feature vectors as (row, slot, value), and which rows are positives and which are unlabelled texts."""

    row: np.ndarray
    slot: np.ndarray
    value: np.ndarray
    positive: np.ndarray
    unlabelled: np.ndarray

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.slot] * self.value, minlength=len(self.positive))

    def gradient(self, off: np.ndarray) -> np.ndarray:
        return np.bincount(self.slot, weights=off[self.row] * self.value, minlength=WIDTH)

    def of(self, keep: np.ndarray) -> Sample:
        place = np.cumsum(keep) - 1
        mine = keep[self.row]
        return Sample(place[self.row[mine]], self.slot[mine], self.value[mine], self.positive[keep], self.unlabelled[keep])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _descend(slope, steps: int, rate: float) -> np.ndarray:
    """Adam: `slope` gives the gradient at a point."""
    w, mean, square = np.zeros(WIDTH), np.zeros(WIDTH), np.zeros(WIDTH)
    for step in range(1, steps + 1):
        g = slope(w)
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w = w - rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return w


def class_prior(sample: Sample, steps: int = 60, rate: float = 0.05, ridge: float = 1e-3, doubt: float = 0.1) -> float:
    """The share of positives among the unlabelled texts, from the tails of a classifier's scores on unseen rows."""
    half = np.arange(len(sample.positive)) % 2 == 0
    fit, rest = sample.of(half), sample.of(~half)
    p, u = fit.positive / max(fit.positive.sum(), 1), fit.unlabelled / max(fit.unlabelled.sum(), 1)

    def slope(w):
        s = _sigmoid(fit.scores(w))
        return fit.gradient((s - 1) * p + s * u) + ridge * w

    scores = rest.scores(_descend(slope, steps, rate))
    good, all_ = np.sort(scores[rest.positive]), np.sort(scores[rest.unlabelled])
    if not len(good) or not len(all_):
        return 0.5
    upper_good = 1 - np.searchsorted(good, good) / len(good)
    upper_all = 1 - np.searchsorted(all_, good) / len(all_)
    allowance = np.sqrt(np.log(4 / doubt) / 2 / len(all_)) + np.sqrt(np.log(4 / doubt) / 2 / len(good))
    best = np.argmin((upper_all + 1.01 * allowance) / upper_good)
    return float(np.clip(upper_all[best] / upper_good[best], 0.01, 0.99))


def risk(scores: np.ndarray, sample: Sample, prior: float) -> tuple[float, float]:
    """The two parts of the unbiased risk with logistic loss: of the positives, and of the negatives (may be below zero)."""
    lost, won = np.logaddexp(0, -scores), np.logaddexp(0, scores)
    n_p, n_u = max(sample.positive.sum(), 1), max(sample.unlabelled.sum(), 1)
    return (float(prior * lost[sample.positive].sum() / n_p),
            float(won[sample.unlabelled].sum() / n_u - prior * won[sample.positive].sum() / n_p))


def train(sample: Sample, prior: float, steps: int = 150, rate: float = 0.05, ridge: float = 1e-4) -> np.ndarray:
    """Weights of least non-negative unbiased risk. Where the negatives' part falls below zero, a step undoes that."""
    p, u = prior * sample.positive / max(sample.positive.sum(), 1), sample.unlabelled / max(sample.unlabelled.sum(), 1)

    def slope(w):
        scores = sample.scores(w)
        s = _sigmoid(scores)
        negative = s * u - s * p
        if risk(scores, sample, prior)[1] >= 0:
            return sample.gradient((s - 1) * p + negative) + ridge * w
        return -sample.gradient(negative) + ridge * w

    return _descend(slope, steps, rate)


# ---------------------------------------------------------------------------
# Rows
# ---------------------------------------------------------------------------


def held_out() -> Column:
    return F.pmod(F.crc32(common.id_text("doc_id").cast("binary")), F.lit(3)) == 1


def sample(docs: DataFrame, labels: DataFrame, positive_docs: int, unlabelled_docs: int) -> Sample:
    """At most so many positives and unlabelled texts, chosen by a hash of id and text, as feature vectors."""
    good = (labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id")
            .agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id"))
    place = F.pmod(F.xxhash64("doc_id", F.lit("positive")), F.lit(1 << 30))
    share = min(1.0, 1.2 * positive_docs / max(good.count(), 1))
    picked = good.where(place < F.lit(int(share * (1 << 30)))).orderBy(place, "doc_id").limit(positive_docs).withColumn("positive", F.lit(True))
    rows = docs.select("doc_id", "text").where(~held_out())
    share = min(1.0, 1.2 * unlabelled_docs / max(rows.count(), 1))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    # at most `positive_docs` ids, so they may be broadcast
    rows = rows.join(F.broadcast(picked), "doc_id", "left").select(
        drawn.alias("drawn"), "text", F.coalesce("positive", F.lit(False)).alias("positive"), (drawn < F.lit(int(share * (1 << 30)))).alias("unlabelled"))

    def vectors(batches):
        for batch in batches:
            for part in common.parts(batch):
                f = features(part.column(1))
                key, place = np.unique(f.row.astype(np.int64) * WIDTH + f.slot, return_inverse=True)
                value = np.bincount(place, weights=f.value, minlength=len(key))
                edges = np.searchsorted(key, np.arange(len(f.style) + 1) * WIDTH)
                slots = [np.concatenate([np.arange(STYLE), key[a:b] % WIDTH]).astype(np.int32) for a, b in zip(edges, edges[1:])]
                values = [np.concatenate([s, value[a:b]]).astype(np.float32) for s, a, b in zip(f.style, edges, edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
                    ["drawn", "positive", "unlabelled", "slots", "values"])

    found = rows.where("positive or unlabelled").mapInArrow(
        vectors, "drawn long, positive boolean, unlabelled boolean, slots array<int>, values array<float>")
    # a repeated id or text may pass the hash any number of times; the limit holds all the same
    found = found.orderBy("drawn", "positive").limit(positive_docs + unlabelled_docs).toArrow()
    n = found.num_rows
    lengths = np.array([len(x) for x in found.column("slots").combine_chunks()] if n else [], np.int64)

    def flat(name, kind):
        return found.column(name).combine_chunks().flatten().to_numpy().astype(kind) if n else np.zeros(0, kind)

    row, slot, value = np.repeat(np.arange(n), lengths), flat("slots", np.int64), flat("values", float)
    often = (np.bincount(slot, minlength=WIDTH) >= LEAST_TEXTS)[slot] | (slot < STYLE)
    return Sample(row[often], slot[often], value[often],
                  *(found.column(c).to_numpy().astype(bool) if n else np.zeros(0, bool) for c in ("positive", "unlabelled")))


def quality_scores(docs: DataFrame, labels: DataFrame, positive_docs: int = 4_000, unlabelled_docs: int = 6_000,
                   threshold: float = 0.5) -> DataFrame:
    """`doc_id, held_out, score, predicted` of every row of `docs(doc_id, text, ...)`.

    `labels(doc_id, quality)` name the trusted positives: ids whose labels are all 1, not held out (crc32 of
    the id as text, mod 3, is 1); labels of 0 teach nothing. `positive_docs` and `unlabelled_docs` bound the
    training sample, whose feature vectors alone reach the driver.

    Null texts count as empty; empty texts get the score of a text without words; null ids stay and count as
    empty text in the held-out rule; repeated rows get equal scores; without a trusted positive every score is
    0.5; an empty table gives an empty result; texts of any length are read whole; other columns are ignored.
    """
    common.ship(docs.sparkSession)
    learned = sample(docs, labels, positive_docs, unlabelled_docs)
    weights = np.zeros(WIDTH)
    if learned.positive.any():
        weights = train(learned, class_prior(learned))
    model = docs.sparkSession.sparkContext.broadcast(weights)
    inner = docs.select("doc_id", held_out().alias("held_out"), "text")

    def rate(batches):
        w = model.value
        for batch in batches:
            for part in common.parts(batch):
                f = features(part.column(2))
                found = f.style @ w[:STYLE] + np.bincount(f.row, weights=w[f.slot] * f.value, minlength=part.num_rows)
                score = _sigmoid(found)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"])

    return inner.mapInArrow(rate, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def op13_quality_classifier(spark, sf):
    return quality_scores(common.table(spark, sf, "documents"), common.table(spark, sf, "labels"))
