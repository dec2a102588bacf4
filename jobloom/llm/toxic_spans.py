"""Operator 10: toxic spans by a linear-chain conditional random field, aggregated to document scores.

Labels mark documents; token labels are drawn from them: a feature of a word (the word, its first and
last letters) that is many times denser in toxic than in other documents marks the tokens that have it
in toxic documents. The CRF (two tags; emissions from hashed word features, transitions, start) is
trained on those tags by gradient steps with forward-backward, in numpy, on a bounded sample.

Scoring is one pass inside the rows. A word's emission is computed once per worker and cached; exact
marginals come from forward-backward over whole texts. The texts of a chunk form one chain in which a
document's first step forgets what went before, cut into blocks that advance side by side. A document's
score is a logistic function of its marginals, calibrated on the part of the sample the CRF did not see;
tokens that are more likely toxic than not give the offending offsets.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

FEATURES = 1 << 18
EDGE = ".,!?;:*$%&#|\"'()[]{}<>-_/\\~`"
BLOCK = 64


class Model(NamedTuple):
    emission: np.ndarray  # weight of each hashed feature for the toxic tag, bias last
    transition: np.ndarray  # 2 x 2, log
    start: np.ndarray  # 2, log
    logistic: np.ndarray  # weights of `document_features`
    empty: float  # score of a text without words


# ---------------------------------------------------------------------------
# Words
# ---------------------------------------------------------------------------


def word_features(word: str) -> list[str]:
    """What is known of a word: lower case without edge punctuation, its beginnings and its ends."""
    w = word.lower().strip(EDGE)
    if not w:
        return []
    return [w, *("^" + w[:n] for n in range(3, 9) if len(w) > n), *(w[-n:] + "$" for n in (3, 4, 5) if len(w) > n)]


def _slots(names: list[str]) -> list[int]:
    import xxhash

    return [xxhash.xxh64_intdigest(n) % FEATURES for n in names]


# ---------------------------------------------------------------------------
# Forward-backward
# ---------------------------------------------------------------------------


def _steps(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One 2 x 2 matrix per token: from the tag before to its own; every first token forgets the tag before."""
    e = np.empty((len(emission), 2))
    e[:, 1] = 1 / (1 + np.exp(-np.clip(emission, -60, 60)))
    e[:, 0] = 1 / (1 + np.exp(np.clip(emission, -60, 60)))
    m = np.exp(transition)[None] * e[:, None, :]
    m[first] = (np.exp(start) * e[first])[:, None, :]
    return m


def marginals(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Exact probability of the toxic tag for every token of the chain; with `pairs` also the summed pair marginals.

    Blocks of `BLOCK` tokens are multiplied up side by side, the few block products one after another.
    """
    n = len(emission)
    if n == 0:
        return (np.zeros(0), np.zeros((2, 2))) if pairs else np.zeros(0)
    m = _steps(emission, first, transition, start)
    blocks = -(-n // BLOCK)
    padded = np.tile(np.eye(2), (blocks * BLOCK, 1, 1))
    padded[:n] = m
    padded = padded.reshape(blocks, BLOCK, 2, 2)
    product = padded[:, 0].copy()
    for k in range(1, BLOCK):
        product = product @ padded[:, k]
        product /= product.sum(axis=(1, 2), keepdims=True)
    rows = product.reshape(blocks, 4).tolist()
    before, a, b = [], 0.5, 0.5
    for p, q, r, s in rows:
        before.append((a, b))
        a, b = a * p + b * r, a * q + b * s
        a, b = a / (a + b), b / (a + b)
    behind, a, b = [], 0.5, 0.5
    for p, q, r, s in reversed(rows):
        behind.append((a, b))
        a, b = p * a + q * b, r * a + s * b
        a, b = a / (a + b), b / (a + b)
    alpha = np.empty((blocks, BLOCK, 2))
    state = np.array(before)
    for k in range(BLOCK):
        state = np.einsum("bi,bij->bj", state, padded[:, k])
        state /= state.sum(axis=1, keepdims=True)
        alpha[:, k] = state
    beta = np.empty((blocks, BLOCK, 2))
    state = np.array(behind[::-1])
    for k in range(BLOCK - 1, -1, -1):
        beta[:, k] = state
        state = np.einsum("bij,bj->bi", padded[:, k], state)
        state /= state.sum(axis=1, keepdims=True)
    alpha, beta = alpha.reshape(-1, 2)[:n], beta.reshape(-1, 2)[:n]
    joint = alpha * beta
    p = joint[:, 1] / joint.sum(axis=1)
    if not pairs:
        return p
    inner = np.flatnonzero(~first[1:]) + 1
    both = alpha[inner - 1][:, :, None] * m[inner] * beta[inner][:, None, :]
    both /= both.sum(axis=(1, 2), keepdims=True)
    return p, both.sum(axis=0)


# ---------------------------------------------------------------------------
# Training
# ---------------------------------------------------------------------------


def _without_copies(texts: list[str]) -> list[int]:
    """One of all texts that share the smallest hash of their 5-word sequences: copies would count as evidence."""
    import xxhash

    seen, keep = set(), []
    for i, text in enumerate(texts):
        words = common.WORDS.findall(text.lower())
        runs = [" ".join(words[k:k + 5]) for k in range(max(1, len(words) - 4))]
        key = min(map(xxhash.xxh64_intdigest, runs))
        if key not in seen:
            seen.add(key)
            keep.append(i)
    return keep


def toxic_features(texts: list[str], toxic: np.ndarray, min_ratio: float = 8.0) -> set[str]:
    """Features that at least 5 toxic texts (and 0.5 % of them) have, `min_ratio` times denser there than elsewhere."""
    counts, spread, words = (Counter(), Counter()), Counter(), [1, 1]
    known: dict[str, list[str]] = {}
    for text, bad in zip(texts, toxic):
        found = Counter()
        for word, n in Counter(common.WORDS.findall(text)).items():
            if word not in known:
                known[word] = word_features(word)
            for f in known[word]:
                found[f] += n
            words[bad] += n
        counts[bad].update(found)
        if bad:
            spread.update(found.keys())
    least = max(5, 0.005 * toxic.sum())
    return {f for f, n in spread.items() if n >= least
            and (counts[1][f] + 0.5) / words[1] >= min_ratio * (counts[0][f] + 0.5) / words[0]}


class _Chain(NamedTuple):
    code: np.ndarray
    first: np.ndarray
    tag: np.ndarray


def _chains(texts: list[str], toxic: np.ndarray, marks: set[str], limit: int = 300_000):
    """Texts as chains of word codes with tags, some `limit` tokens each; and the feature slots of each word code."""
    codes: dict[str, int] = {}
    slots, marked, chains = [], [], []
    code, first, tag = [], [], []
    for text, bad in zip(texts, toxic):
        for i, word in enumerate(common.WORDS.findall(text)):
            c = codes.get(word)
            if c is None:
                c = codes[word] = len(codes)
                names = word_features(word)
                slots.append(_slots(names))
                marked.append(any(n in marks for n in names))
            code.append(c)
            first.append(i == 0)
            tag.append(bool(bad) and marked[c])
        if len(code) >= limit:
            chains.append(_Chain(np.array(code), np.array(first), np.array(tag)))
            code, first, tag = [], [], []
    if code:
        chains.append(_Chain(np.array(code), np.array(first), np.array(tag)))
    sizes = np.array([len(s) for s in slots], np.int64)
    return chains, np.repeat(np.arange(len(slots)), sizes), np.array([x for s in slots for x in s], np.int64)


def train_crf(texts: list[str], toxic: np.ndarray, steps: int = 50, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emission weights (bias last), transitions and start, by Adam on the mean log-likelihood of the tags."""
    chains, word, slot = _chains(texts, toxic, toxic_features(texts, toxic))
    theta = np.zeros(FEATURES + 1 + 4 + 2)
    theta[FEATURES] = -4.0
    total = max(1, sum(len(c.code) for c in chains))
    words = int(word.max()) + 1 if len(word) else 0
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    words = max(words, 1 + max((int(c.code.max()) for c in chains), default=0))
    for step in range(1, steps + 1):
        score = np.bincount(word, weights=theta[slot], minlength=words) + theta[FEATURES]
        transition, start = theta[FEATURES + 1:FEATURES + 5].reshape(2, 2), theta[FEATURES + 5:]
        off, gradient = np.zeros(words), np.zeros_like(theta)
        for c in chains:
            p, both = marginals(score[c.code], c.first, transition, start, pairs=True)
            off += np.bincount(c.code, weights=p - c.tag, minlength=words)
            inner = np.flatnonzero(~c.first[1:]) + 1
            seen = np.bincount(2 * c.tag[inner - 1] + c.tag[inner], minlength=4).reshape(2, 2)
            gradient[FEATURES + 1:FEATURES + 5] += (both - seen).ravel()
            begun = (p - c.tag)[c.first].sum()
            gradient[FEATURES + 5:] += [-begun, begun]
        gradient[:FEATURES] += np.bincount(slot, weights=off[word], minlength=FEATURES)
        gradient[FEATURES] += off.sum()
        gradient = gradient / total * 100 + decay * theta
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient ** 2
        theta -= rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return theta[:FEATURES + 1], theta[FEATURES + 1:FEATURES + 5].reshape(2, 2), theta[FEATURES + 5:]


def document_features(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document: its strongest marginals (log-odds), expected toxic words, their share, and its length."""
    out = np.zeros((len(sizes), 6))
    out[:, 0] = 1
    out[:, 5] = np.log1p(sizes) / 5
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[full]
        strongest = np.maximum.reduceat(p, starts)
        expected = np.add.reduceat(p, starts)
        out[full, 1] = np.log(np.clip(strongest, 1e-6, 1 - 1e-6) / (1 - np.clip(strongest, 1e-6, 1 - 1e-6))) / 5
        out[full, 2] = np.log1p(expected)
        out[full, 3] = np.minimum(100 * expected / sizes[full], 5) / 5
        out[full, 4] = np.log1p(np.add.reduceat((p >= 0.5).astype(float), starts))
    out[sizes == 0, 1] = -3
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps; a constant label gives a constant score."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[str], toxic: np.ndarray, odds: float = 1.0) -> Model:
    """A model from labelled texts; `odds` is how many unsampled rows a toxic row stands for, against one of the others."""
    keep = _without_copies(texts)
    texts, toxic = [texts[i] for i in keep], np.asarray(toxic, int)[keep]
    fit, rest = np.arange(len(texts)) % 3 != 0, np.arange(len(texts)) % 3 == 0
    emission, transition, start = train_crf([t for t, f in zip(texts, fit) if f], toxic[fit])
    model = Model(emission, transition, start, np.zeros(6), 0.0)
    held = [t for t, r in zip(texts, rest) if r]
    if not held:
        return model
    scorer, x = Scorer(model, 200_000), []
    for i in range(0, len(held), 200):
        p, sizes = scorer.tokens(held[i:i + 200])
        x.append(document_features(p, sizes))
    weight = np.where(toxic[rest] == 1, odds, 1.0)
    logistic = _logistic(np.vstack(x), toxic[rest], weight)
    return model._replace(logistic=logistic, empty=float(1 / (1 + np.exp(-document_features(np.zeros(0), np.zeros(1, np.int64))[0] @ logistic))))


# ---------------------------------------------------------------------------
# Scoring
# ---------------------------------------------------------------------------


class Scorer:
    """A model with a worker's cache of word emissions, which starts afresh when full."""

    def __init__(self, model: Model, cache_entries: int):
        self.model, self.limit = model, cache_entries
        self.cache: dict[str, float] = {}
        self.weights = model.emission.tolist()

    def _emission(self, word: str) -> float:
        e = sum(map(self.weights.__getitem__, _slots(word_features(word))), self.weights[-1])
        if len(word) <= 64:
            self.cache[word] = e
        return e

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all words of the texts, and each text's number of words."""
        if len(self.cache) > self.limit:
            self.cache.clear()
        words, sizes = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = common.WORDS.findall(text or "")
            sizes[i] = len(found)
            words += found
        emission = list(map(self.cache.get, words))
        if None in emission:
            for i, e in enumerate(emission):
                if e is None:
                    word = words[i]
                    known = self.cache.get(word)
                    emission[i] = self._emission(word) if known is None else known
        first = np.zeros(len(words), bool)
        starts = np.cumsum(sizes) - sizes
        first[starts[sizes > 0]] = True
        return marginals(np.array(emission, float), first, self.model.transition, self.model.start), sizes

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
        p, sizes = self.tokens(texts)
        scores = 1 / (1 + np.exp(-np.clip(document_features(p, sizes) @ self.model.logistic, -30, 30)))
        spans: list[list[dict]] = []
        at = 0
        for text, n in zip(texts, sizes):
            bad = np.flatnonzero(p[at:at + n] >= 0.5)
            spans.append(_spans(text, bad) if len(bad) else [])
            at += n
        return scores, spans


def _spans(text: str, bad: np.ndarray) -> list[dict]:
    """Code point spans of the words with these places; neighbours are one span."""
    places = [m.span() for m in common.WORDS.finditer(text)]
    out: list[dict] = []
    last = -2
    for i in bad.tolist():
        if i == last + 1:
            out[-1]["end"] = places[i][1]
        else:
            out.append({"start": places[i][0], "end": places[i][1]})
        last = i
    return out


def learnable() -> F.Column:
    """Rows labels may be learned from: crc32 of the id as text, mod 3, is not 1."""
    return F.pmod(F.crc32(common.id_text("doc_id").cast("binary")), F.lit(3)) != 1


def sample(docs: DataFrame, labels: DataFrame, toxic_docs: int, other_docs: int) -> tuple[list[str], np.ndarray, float]:
    """About so many texts of either label, chosen by a hash of the id, and the odds of `train`."""
    labels = labels.where("toxic is not null and doc_id is not null").where(learnable()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    many = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {1: min(1.0, toxic_docs / max(many.get(1, 0), 1)), 0: min(1.0, other_docs / max(many.get(0, 0), 1))}
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    limit = F.when(F.col("toxic") == 1, F.lit(int(share[1] * (1 << 30)))).otherwise(F.lit(int(share[0] * (1 << 30))))
    picked = labels.where(place < limit)
    # the sample has a bounded number of rows, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("text is not null").distinct().collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return [r.text for r in rows], np.array([int(r.toxic == 1) for r in rows], int), share[0] / share[1]


def toxic_spans(docs: DataFrame, labels: DataFrame, toxic_docs: int = 1_500, other_docs: int = 3_500, threshold: float = 0.7,
                cache_entries: int = 400_000) -> DataFrame:
    """`doc_id, held_out, score, predicted, spans` of every row of `docs(doc_id, text, ...)`.

    `labels(doc_id, toxic)` teach; of more rows than `toxic_docs` and `other_docs` (the bound of the
    training sample), about so many are chosen by hash. Of several labels of a document the largest counts.
    `spans` are code point offsets of the words tagged toxic.

    Null and empty texts get the score of a text without words; null ids stay and are no training rows;
    repeated rows get equal scores; without any labelled row every score is 0.5 (not toxic); an empty
    table gives an empty result; texts of any length are read whole; other columns are ignored.
    """
    common.ship(docs.sparkSession)
    texts, toxic, odds = sample(docs, labels, toxic_docs, other_docs)
    model = docs.sparkSession.sparkContext.broadcast(train(texts, toxic, odds))
    inner = docs.select("doc_id", (~learnable()).alias("held_out"), "text")
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def rate(batches):
        scorer = Scorer(model.value, cache_entries)
        for batch in batches:
            for part in common.parts(batch, limit=800_000):
                scores, found = scorer.score(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32)), pa.array(found, spans)],
                    ["doc_id", "held_out", "score", "predicted", "spans"])

    return inner.mapInArrow(rate, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int>>")


def op10_toxic_spans(spark, sf):
    return toxic_spans(common.table(spark, sf, "documents"), common.table(spark, sf, "labels"))
