"""Operator 7: benchmark decontamination by latent semantic retrieval and longest common subsequence.

Fit: a randomised SVD of the TF-IDF matrix of all passages of all documents and benchmark items
(features are hashed words, document frequencies come from all documents). Words are cut once and written as
features, two bytes each; frequencies and rounds read those. Rows stay on the executors: each round is one pass that sends one features-by-rank product per task, summed in blocks, and the last
product gives the directions too (Nystroem), so no pass goes into values alone.
The right singular vectors, scaled by the inverse singular values, map words to a latent space.

Search: every window of every whole document (windows as long as the items, a quarter apart) is compared
with the items by cosine, inside the rows and without a shuffle. A candidate is a leak if the longest
common subsequence of window and item is long enough and the item's answer is found too, so reordered
or reworded passages count, and texts that only share common words do not. An item longer than the longest
window has a vector for each of its parts; a window like one of them says where the whole item would lie,
and the item is compared with all of that passage. Items of a few words are sought by fingerprints of
word runs, without vectors.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

FEATURE_BITS = 15
FEATURES = 1 << FEATURE_BITS
RANK, EXTRA, ROUNDS = 64, 8, 1
PASSAGE = 48
#: Passages that are multiplied together: as dense rows over the features that one of them has.
TOGETHER_BITS = 3
TOGETHER = 1 << TOGETHER_BITS
#: Items of fewer words are too short to be told by chance from common words: all of it, in one piece.
SHORT = 8
#: Window lengths in words; an item, or a part of a longer one, is sought in those of the first length that holds it.
LENGTHS = (8, 12, 20, 28, 40, 60, 92, 136, 200, 300)
#: Words whose vectors are summed before windows are; window lengths and steps are multiples of it.
GRAIN = 4
#: Items whose vectors and words travel with the tasks at a time; more items are sought in more passes.
ITEMS_PER_PASS = 4_000
#: Cosines held at a time.
CELLS = 1 << 22
#: Bytes of text worked on at a time: every word has a latent vector meanwhile.
CHUNK = 400_000
#: Bytes of text that a task of the fit has at least, where one pass has more tasks than cores: each sends a whole product.
TASK_BYTES = 64 << 20
BLOCK_ROWS = 1024

_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_EDGE = np.zeros(256, bool)
_EDGE[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True


class Words(NamedTuple):
    """Words of a chunk: fingerprint without edge punctuation and case, the row, and where each row's begin."""

    prints: np.ndarray
    row: np.ndarray
    edges: np.ndarray


def words_of(texts) -> Words:
    offsets, data = common.utf8(texts)
    data = common.lowered(data)
    starts, ends, row = common.word_spans(offsets, data)
    inner = np.append(np.flatnonzero(~_EDGE[data]), len(data))
    edge = np.flatnonzero(_EDGE[data[starts]])
    starts[edge] = inner[np.searchsorted(inner, starts[edge])]
    keep = starts < ends  # words of punctuation alone are left out
    starts, ends, row = starts[keep], ends[keep], row[keep]
    edge = np.flatnonzero(_EDGE[data[ends - 1]])
    ends[edge] = inner[np.searchsorted(inner, ends[edge]) - 1] + 1
    return Words(common.Spans(data).of(starts, ends), row, np.searchsorted(row, np.arange(len(offsets))))


def features(prints: np.ndarray) -> np.ndarray:
    return (prints >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


# ---------------------------------------------------------------------------
# Fit
# ---------------------------------------------------------------------------


def feature_rows(rows: DataFrame) -> DataFrame:
    """`weight, words` of every row of `rows(text, weight)`: the features of all its words in order, two bytes each."""
    def cut(batches):
        for batch in batches:
            for part in common.parts(batch, limit=CHUNK):
                words = words_of(part.column(0))
                raw = features(words.prints).astype("<u2").tobytes()
                edges = (2 * words.edges).tolist()
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([raw[a:b] for a, b in zip(edges, edges[1:])], pa.binary())], ["weight", "words"])

    return rows.select("text", "weight").mapInArrow(cut, "weight double, words binary")


class Features(NamedTuple):
    """What `Words` has, with features for fingerprints."""

    feature: np.ndarray
    row: np.ndarray
    edges: np.ndarray


def features_of(words: pa.Array) -> Features:
    """The features of a chunk of `feature_rows`."""
    offsets, data = common.utf8(words)
    sizes = np.diff(offsets) // 2
    return Features(data.view("<u2").astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), offsets // 2)


def document_frequencies(words: DataFrame) -> tuple[np.ndarray, int]:
    """How many rows of `feature_rows` have each feature, over all rows, and how many rows there are."""
    def count(batches):
        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for part in common.parts(batch, "words", CHUNK // 3):
                held = features_of(part.column(0))
                once = np.unique(held.row * FEATURES + held.feature)
                total += np.bincount(once % FEATURES, minlength=FEATURES)
                n += part.num_rows
        yield _blocks(total.astype(np.float32), n)

    rows = words.select("words").mapInArrow(count, _BLOCKS).groupBy("block").applyInPandas(_sum_blocks, _BLOCKS).collect()
    out = np.zeros(FEATURES)
    for r in rows:
        out[r["block"] * BLOCK_ROWS:(r["block"] + 1) * BLOCK_ROWS] = np.frombuffer(bytes(r["sums"]), np.float32)
    return out, sum(r["n"] for r in rows)


_BLOCKS = "block long, n long, sums binary"


def _blocks(total: np.ndarray, n: int) -> pa.RecordBatch:
    """A task's share of a sum over features, one row per block of features; the first also has a count."""
    many = FEATURES // BLOCK_ROWS
    return pa.RecordBatch.from_arrays([pa.array(range(many), pa.int64()), pa.array([n] + [0] * (many - 1), pa.int64()),
                                       pa.array([b.tobytes() for b in np.split(total, many)], pa.binary())], ["block", "n", "sums"])


def _sum_blocks(frame: pd.DataFrame) -> pd.DataFrame:
    """One block of a sum over tasks; every task sends one row per block."""
    total = sum(np.frombuffer(bytes(b), np.float32) for b in frame["sums"])
    return pd.DataFrame({"block": frame["block"].iloc[:1], "n": [frame["n"].sum()], "sums": [total.tobytes()]})


def passages(texts, weight: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """TF-IDF rows of unit length (row, feature, value) of the `PASSAGE`-word passages of texts, as `passage_rows` gives them."""
    words = words_of(texts)
    return passage_rows(Features(features(words.prints), words.row, words.edges), weight, idf)


def passage_rows(words: Features, weight: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Row, feature and value of the passages of texts, and the number of passages; by `TOGETHER` rows, then feature, then row."""
    place = np.arange(len(words.row)) - words.edges[words.row]
    # words come by row and place, so a passage begins where either changes
    passage = np.cumsum(np.diff(words.row * (1 << 32) + place // PASSAGE, prepend=-1) != 0) - 1
    keys = (passage >> TOGETHER_BITS << FEATURE_BITS | words.feature) << TOGETHER_BITS | passage & TOGETHER - 1
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=-1) != 0)
    tf = np.diff(first, append=len(keys))
    keys = keys[first]
    feature = keys >> TOGETHER_BITS & FEATURES - 1
    row = keys >> FEATURE_BITS + TOGETHER_BITS << TOGETHER_BITS | keys & TOGETHER - 1
    value = tf * idf[feature]
    n = int(passage[-1]) + 1 if len(passage) else 0
    length = np.sqrt(np.bincount(row, weights=value ** 2, minlength=n))
    of = np.zeros(n, np.int64)
    of[passage] = words.row
    return row, feature, value / np.where(length == 0, 1, length)[row] * weight[of][row], n


def add_product(total: np.ndarray, row, feature, value, n, right: np.ndarray) -> None:
    """Add A'A times a dense matrix for sparse rows A in the order of `passage_rows`, in place, `TOGETHER` rows at a time."""
    value = value.astype(np.float32)
    several, member = row >> TOGETHER_BITS, row & TOGETHER - 1
    new = np.diff(several << FEATURE_BITS | feature, prepend=-1) != 0
    column, heads = np.cumsum(new) - 1, feature[new]
    edges = np.searchsorted(several, np.arange(-(-n // TOGETHER) + 1)).tolist()
    for a, b in zip(edges[:-1], edges[1:]):
        low, high = int(column[a]), int(column[b - 1]) + 1
        dense = np.zeros((TOGETHER, high - low), np.float32)
        dense[member[a:b], column[a:b] - low] = value[a:b]
        at = heads[low:high]
        total[at] += dense.T @ (dense @ right.take(at, axis=0))


def fit_rows(docs: DataFrame, items: DataFrame, weight: float) -> DataFrame:
    """`text, weight` of all documents with text and all items."""
    return docs.where("text is not null").select("text", F.lit(1.0).alias("weight")).union(items.select("text", F.lit(float(weight)).alias("weight")))


def in_few_tasks(words: DataFrame) -> DataFrame:
    """`words, weight` in few tasks: each sends a whole product (9 MB) in every pass."""
    size = words.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    # a word and what follows it are some six bytes of text
    return words.coalesce(max(words.sparkSession.sparkContext.defaultParallelism, -(-3 * size // TASK_BYTES)))


def fit(rows: DataFrame, idf: np.ndarray, words: DataFrame | None = None, seed: int = 5) -> np.ndarray:
    """Latent vectors (features x `RANK`) of `rows(text, weight)`, idf and whitening folded in.

    `words` are the same rows as `feature_rows` gives them, where they are written already.
    `ROUNDS` passes over all rows turn the basis to the largest directions of A'A; one more gives its product with
    them, from which come directions and singular values.
    """
    spark = rows.sparkSession
    words = in_few_tasks(common.saved(feature_rows(rows), "leak-words") if words is None else words)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(FEATURES, RANK + EXTRA)))[0].astype(np.float32)
    for step in range(ROUNDS + 1):
        shared = spark.sparkContext.broadcast((basis, idf))

        def multiply(batches):
            basis, idf = shared.value
            total = np.zeros((FEATURES, basis.shape[1]), np.float32)
            for batch in batches:
                for part in common.parts(batch, "words", CHUNK // 3):
                    row, feature, value, n = passage_rows(features_of(part.column(1)), part.column(0).to_numpy(), idf)
                    add_product(total, row, feature, value, n, basis)
            yield _blocks(total, 0)

        sums = words.mapInArrow(multiply, _BLOCKS).groupBy("block").applyInPandas(_sum_blocks, _BLOCKS).collect()
        image = np.zeros(basis.shape)
        for r in sums:
            image[r["block"] * BLOCK_ROWS:(r["block"] + 1) * BLOCK_ROWS] = np.frombuffer(bytes(r["sums"]), np.float32).reshape(BLOCK_ROWS, -1)
        shared.destroy()
        if step < ROUNDS:
            basis = np.linalg.qr(image)[0].astype(np.float32)
    # Nystroem: A'A is near image (basis' image)^-1 image', so one more turn of the basis comes with the last pass
    inner, turn = np.linalg.eigh(basis.astype(np.float64).T @ image)
    used = inner > 1e-6 * max(inner[-1], 1e-30)
    directions, sizes = np.linalg.svd(image @ (turn[:, used] / np.sqrt(inner[used])), full_matrices=False)[:2]
    latent = np.zeros((FEATURES, RANK))
    sizes = sizes[:RANK]
    # rows of no word at all have no direction; sizes are the singular values of A
    held = sizes > 3e-5 * max(sizes[0] if len(sizes) else 0.0, 1e-30)
    latent[:, :len(sizes)][:, held] = directions[:, :RANK][:, held] / sizes[held]
    return (latent * idf[:, None]).astype(np.float32)


# ---------------------------------------------------------------------------
# Search
# ---------------------------------------------------------------------------


class Item(NamedTuple):
    item_id: int | None
    words: list[int]
    answer: list[int]


class Index(NamedTuple):
    latent: np.ndarray  # a row for each feature, and one of zeros
    items: list[Item]
    vectors: np.ndarray  # unit rows, for every item or part of one
    length: np.ndarray  # place in LENGTHS, of each vector
    of: np.ndarray  # the item of each vector
    offset: np.ndarray  # the word of the item that the vector's part begins with
    runs: list[tuple[int, np.ndarray, np.ndarray]]  # words, ascending fingerprints and items of the short ones


def answer_part(text: str) -> str:
    """The last sentence of an item."""
    pieces = [p for p in text.replace("\n", ". ").replace("? ", ". ").replace("! ", ". ").split(". ") if common.WORDS.search(p)]
    return pieces[-1] if pieces else ""


def index_items(rows: list, latent: np.ndarray) -> Index:
    texts = [r["text"] for r in rows]
    words, answers = words_of(pa.array(texts, pa.string())), words_of(pa.array([answer_part(t) for t in texts], pa.string()))
    items, vectors, length, of, offset = [], [], [], [], []
    short: dict[int, list] = {}
    for i, r in enumerate(rows):
        own = words.prints[words.edges[i]:words.edges[i + 1]]
        if not len(own):
            continue
        items.append(Item(r["item_id"], own.tolist(), answers.prints[answers.edges[i]:answers.edges[i + 1]].tolist()))
        if len(own) < SHORT:
            short.setdefault(len(own), []).append((int(run_prints(own, len(own))[0]), len(items) - 1))
            continue
        many = -(-len(own) // LENGTHS[-1])
        size = -(-len(own) // many)
        for start in range(0, len(own), size):
            vector = latent[features(own[start:start + size])].sum(axis=0)
            vectors.append(vector / max(float(np.linalg.norm(vector)), 1e-30))
            length.append(int(np.searchsorted(LENGTHS, size)))
            of.append(len(items) - 1)
            offset.append(start)
    runs = [(n, np.array([p for p, _ in sorted(held)], np.uint64), np.array([i for _, i in sorted(held)])) for n, held in sorted(short.items())]
    return Index(np.concatenate([latent, np.zeros((1, latent.shape[1]), np.float32)]), items, np.array(vectors, np.float32).reshape(len(vectors), latent.shape[1]), np.array(length, int),
                 np.array(of, int), np.array(offset, int), runs)


def running_sums(rows: np.ndarray, step: int = 16) -> np.ndarray:
    """Sums of the first 0, 1, 2, ... rows: within blocks of `step` rows, all blocks at once, then over blocks."""
    n, width = rows.shape
    blocks = np.zeros((-(-(n + 1) // step) * step, width), rows.dtype)
    blocks[1:n + 1] = rows
    blocks = blocks.reshape(-1, step, width)
    for j in range(1, step):
        blocks[:, j] += blocks[:, j - 1]
    blocks[1:] += np.cumsum(blocks[:-1, -1], axis=0)[:, None]
    return blocks.reshape(-1, width)[:n + 1]


def run_prints(prints: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the `n` words from each word on that has so many."""
    out = prints[:max(0, len(prints) - n + 1)].copy()
    for j in range(1, n):
        out = common.mixed(out * _STEP + prints[j:len(out) + j])
    return out


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    place: dict = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for y in b:
        hit = state & place.get(y, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def _judged(item: Item, window: list, sure: float, likely: float) -> float | None:
    """The share of the item found in the window if that makes a leak, else None."""
    n = len(item.words)
    # no subsequence is longer than the number of its words that occur at all
    if sum(map(set(window).__contains__, item.words)) < likely * n:
        return None
    share = common_subsequence(item.words, window) / n
    if share >= sure:
        return share
    if share < likely:
        return None
    return share if common_subsequence(item.answer, window) >= 0.5 * len(item.answer) else None


def _short_leaks(words: Words, index: Index) -> list[tuple[int, int, float, float, int, int]]:
    """The first place of every short item in every row, as `leaks` gives them."""
    out = []
    for n, prints, items in index.runs:
        found = run_prints(words.prints, n)
        low, high = np.searchsorted(prints, found), np.searchsorted(prints, found, side="right")
        at = np.flatnonzero((low < high) & (words.row[:len(found)] == words.row[n - 1:]))
        for i in at[np.unique(words.row[at] * len(prints) + low[at], return_index=True)[1]]:
            row = int(words.row[i])
            place = int(i - words.edges[row])
            out.extend((row, int(j), 1.0, 1.0, place, place + n) for j in items[low[i]:high[i]])
    return out


def leaks(texts, index: Index, least_cosine: float, sure: float, likely: float) -> list[tuple[int, int, float, float, int, int]]:
    """`(row, item, share, cosine, first word, word after the last)` of every leaked item of every text, once each."""
    words = words_of(texts)
    counts = np.diff(words.edges)
    grains = -(-counts // GRAIN)
    ends_at = np.cumsum(grains)
    first = ends_at - grains
    of = np.repeat(np.arange(len(counts)), grains)
    places = words.edges[of] + (np.arange(len(of)) - first[of]) * GRAIN
    sums = np.zeros((1, index.latent.shape[1]), np.float32)
    if len(of):
        feature, last = features(words.prints), words.edges[1:][of]
        grain = index.latent.take(feature[places], axis=0)
        for j in range(1, GRAIN):
            at = places + j
            grain += index.latent.take(np.where(at < last, feature[np.minimum(at, len(feature) - 1)], FEATURES), axis=0)
        sums = running_sums(grain)
    out = _short_leaks(words, index)
    for k in np.unique(index.length):
        mine = np.flatnonzero(index.length == k)
        size = LENGTHS[k]
        step = max(1, size // GRAIN // 4)
        many = np.where(counts > 0, 1 + np.maximum(0, -(-(grains - size // GRAIN) // step)), 0)
        row = np.repeat(np.arange(len(counts)), many)
        start = first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * step
        end = np.minimum(start + size // GRAIN, ends_at[row])
        block = max(256, min(65_536, CELLS // len(mine)))
        for a in range(0, len(row), block):
            b = slice(a, a + block)
            vectors = sums.take(end[b], axis=0)
            vectors -= sums.take(start[b], axis=0)
            vectors /= np.maximum(np.sqrt(np.einsum("ij,ij->i", vectors, vectors)), 1e-30)[:, None]
            cosine = vectors @ index.vectors[mine].T
            at, which = np.divmod(np.flatnonzero(cosine.ravel() >= least_cosine), len(mine))
            order = np.lexsort((-cosine[at, which], index.of[mine[which]], row[b][at]))
            found, now, tried = None, None, set()
            for i in order.tolist():
                w, v = at[i] + a, int(mine[which[i]])
                r, j = int(row[w]), int(index.of[v])
                if found == (r, j):
                    continue
                if now != (r, j):
                    now, tried = (r, j), set()
                item, n = index.items[j], len(index.items[j].words)
                begin, slack = int(words.edges[r]), n // 4
                low, high = int(start[w] - first[r]) * GRAIN, int(end[w] - first[r]) * GRAIN
                if n > LENGTHS[-1]:
                    # where the whole item lies if the window is this part of it; near places give one passage
                    near = n // 32
                    low = (low - int(index.offset[v])) // near * near
                    high = low + n + near
                lo, hi = begin + max(0, low - slack), min(int(words.edges[r + 1]), begin + high + slack)
                if (lo, hi) in tried:
                    continue
                tried.add((lo, hi))
                share = _judged(item, words.prints[lo:hi].tolist(), sure, likely)
                if share is not None:
                    found = (r, j)
                    out.append((r, j, share, float(cosine[at[i], which[i]]), lo - int(words.edges[r]), hi - int(words.edges[r])))
    best: dict = {}
    for x in out:  # a document may have been cut between blocks of windows
        if x[:2] not in best or x[2:4] > best[x[:2]][2:4]:
            best[x[:2]] = x
    return list(best.values())


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, least_cosine: float = 0.65,
                    sure: float = 0.75, likely: float = 0.55) -> DataFrame:
    """`doc_id, item_id, share, cosine, first_word, last_word` for every document that holds a benchmark item.

    A leak is a window with a latent cosine of `least_cosine` or more and a common subsequence of at least
    `sure` of the item's words, or of `likely` with half of its answer (its last sentence). Items of fewer
    than eight words count only in one piece, wherever that is (share and cosine are 1, the words given those
    of the first piece). For an item longer than the longest window, the window must be like one of its parts,
    and the shares are those of the whole item in a passage of its length round that window; the cosine given
    is the part's. The words given are those of the widened window or passage.
    The latent space is fitted on all passages of all documents and items.

    Null and empty documents hold nothing, null and empty items are held by nothing. Null ids are carried
    as they are; repeated rows each give a row; empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    common.ship(spark)
    docs = docs.select("doc_id", "text")
    items = benchmark.select("item_id", "text").where("text is not null").dropDuplicates()
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, share double, cosine double, first_word long, last_word long"
    with common.small_batches(spark):
        words = common.saved(feature_rows(docs.select("text", F.lit(1.0).alias("weight"))), "leak-words")
        frequency, total = document_frequencies(words)
        idf = np.log((1 + total) / (1 + frequency)).astype(np.float32)
        # items weigh as much as the documents, so that the space tells them apart
        n_items = items.count()
        weight = max(1.0, (total * 10 / max(n_items, 1)) ** 0.5)
        latent = np.zeros((FEATURES, RANK), np.float32)
        if n_items:
            rows = fit_rows(docs, items, weight)
            latent = fit(rows, idf, words.union(feature_rows(items.select("text", F.lit(float(weight)).alias("weight")))))
        common.removed(words)

    passes = max(1, -(-n_items // ITEMS_PER_PASS))
    out = None
    for k in range(passes):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()
        shared = spark.sparkContext.broadcast(index_items(sorted(block, key=lambda r: (str(r["item_id"]), r["text"])), latent))

        def search(batches, shared=shared):
            index = shared.value
            for batch in batches:
                for part in common.parts(batch, limit=CHUNK):
                    found = leaks(part.column(1), index, least_cosine, sure, likely) if index.items else []
                    ids = part.column(0).to_pylist()
                    columns = [[ids[f[0]] for f in found], [index.items[f[1]].item_id for f in found], *([f[i] for f in found] for i in range(2, 6))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.schema.field(0).type, *kinds])], names)

        names = ["doc_id", "item_id", "share", "cosine", "first_word", "last_word"]
        kinds = [pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        part = docs.mapInArrow(search, schema)
        out = part if out is None else out.union(part)
    return out


def op7_benchmark_leaks(spark, sf):
    return benchmark_leaks(common.table(spark, sf, "documents"), common.table(spark, sf, "benchmark"))


def decontamination_stage(spark, docs, sf_dir):
    """Documents without a leaked benchmark item.

    A row goes by a fingerprint of its id and text: a leak in a row with a null or repeated id takes that row
    and its equals alone. Null and empty texts hold nothing and stay; repeated rows stay or go together; an empty
    table stays empty; other columns are kept as they are.
    """
    named = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    leaked = benchmark_leaks(named.select(F.col("__row").alias("doc_id"), "text"), common.table(spark, sf_dir, "benchmark"))
    with common.small_batches(spark):
        gone = common.saved(leaked.select(F.col("doc_id").alias("__row")).distinct(), "leak-rows")
    return named.join(gone, "__row", "left_anti").select(docs.columns)
