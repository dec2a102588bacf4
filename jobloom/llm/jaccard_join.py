"""Operator 6: all documents linked by n-gram Jaccard similarity, by a grouped prefix join.

The shingles of every document are put in one order, rare before frequent (frequent ones are counted
over all documents on the map side). Two sets can only reach the threshold if their prefixes (the
first n - ceil(t n) + 1 shingles) share one. Documents with equal prefix and size form one group; groups meet in
the buckets of their prefix shingles, group pairs are filtered by size and position, then expanded to
their members (distinct sets), filtered by parity bitmaps, and verified on whole texts.

The result is components, so pairs of documents that are known to be connected need no check, and no
bucket emits all its pairs: each member first meets its neighbours by size (a few, in an order that is the
same in all buckets), verified links are joined to components, and then, in the buckets where several
components are left, only members outside the largest component meet the others. They meet inside a task,
in blocks of bounded size, as arrays of sizes, positions and bitmaps; only pairs that pass leave it, at first
each member's closest few, so that most members join a component before the rest are asked for. That loses
no link between components.

Every number in a pruning rule is exact or a bound; frequencies only change the order, and so the work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common
from .components import components, merged_labels, nearby
from .shingles import shingle_sets

BITS = 2048
#: Most cells of the bitmap of a set with more shingles than `BITS`, whose cells are all taken: two to four cells a shingle.
WIDE_BITS = 1 << 17
#: Shingles counted in more documents than this are dealt to several buckets.
HOT = 4096
NEIGHBOURS = 4
#: Members of a bucket, and those outside its largest component, that one task's block holds.
BLOCK = 4096
#: Pairs that a set outside asks for in each round; the last, None, means all.
LIMITS = (8, 64, None)
#: Pairs whose bitmaps are compared at a time.
PAIRS = 1 << 16
#: Shingles of the pairs that are verified in one place.
PLACE = 4_000_000
#: Groups and sets a task remembers so as not to write them twice.
SEEN = 100_000
#: Bytes of text worked on at a time: a word takes some ten times its own bytes meanwhile.
CHUNK = 500_000


def frequent_shingles(docs: DataFrame, k: int, entries: int = 300_000, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (ascending) and counts of at most `entries` shingles that many documents have.

    Each task counts all its documents and drops, per two million shingles, what it saw fewer than
    `least` times; the rest is summed. The counts order shingles, no result depends on them.
    """
    def count(batches):
        held, size = [], 0
        total: dict[str, np.ndarray] = {"h": np.zeros(0, np.uint64), "n": np.zeros(0, np.int64)}

        def flush():
            nonlocal held, size
            if not held:
                return
            h, n = np.unique(np.concatenate(held), return_counts=True)
            h, n = h[n >= least], n[n >= least]
            both, place = np.unique(np.concatenate([total["h"], h]), return_inverse=True)
            sums = np.bincount(place, weights=np.concatenate([total["n"], n]), minlength=len(both)).astype(np.int64)
            if len(both) > 2 * entries:
                top = np.sort(np.argpartition(-sums, entries)[:entries])
                both, sums = both[top], sums[top]
            total["h"], total["n"] = both, sums
            held, size = [], 0

        for batch in batches:
            for part in common.parts(batch, limit=CHUNK):
                prints = shingle_sets(part.column(0), k)[1]
                held.append(prints)
                size += len(prints)
                if size >= 2_000_000:
                    flush()
        flush()
        for i in range(0, len(total["h"]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(common.signed(total["h"][i:i + 50_000])), pa.array(total["n"][i:i + 50_000])], ["h", "n"])

    counts = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.col("n").desc(), "h").limit(entries).toPandas()
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], rows["n"].to_numpy(np.int64)[order]


def _fold(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of fingerprints; empty runs give 0."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mixed(x ^ np.uint64(0xA0761D6478BD642F)))])
    return common.mixed(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64))


def signatures(docs: DataFrame, k: int, percent: int, hot: tuple[np.ndarray, np.ndarray], crowd: int = HOT) -> DataFrame:
    """`doc_id, uid, n, s, g` of every row of `docs(doc_id, uid, text)`: set size, fingerprints of the set and of its group (prefix and size).

    The first row of a group in a task also has the prefix (`tokens`, and the bucket `parts` of frequent
    ones), the first row of a set its parity bitmap (`bits`) and, if it has more than `BITS` shingles, a wider one (`wide`).
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    kind = dict(docs.dtypes)["doc_id"]

    def rows(batches):
        often, counts = shared.value
        groups_seen, sets_seen = set(), set()
        for batch in batches:
            for part in common.parts(batch, limit=CHUNK):
                offsets, prints = shingle_sets(part.column(2), k)
                sizes = np.diff(offsets)
                row = np.repeat(np.arange(len(sizes)), sizes)
                count = np.zeros(len(prints), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, prints), len(often) - 1)
                    count = np.where(often[at] == prints, counts[at], 0)
                order = np.lexsort((prints, count, row))
                ordered, count = prints[order], count[order]
                lengths = np.where(sizes > 0, sizes + (-percent * sizes) // 100 + 1, 0)
                place = np.arange(len(ordered)) - np.repeat(offsets[:-1], sizes)
                front = place < lengths[row]
                tokens, front_counts = ordered[front], count[front]
                edges = np.concatenate([[0], np.cumsum(lengths)])
                s = _fold(prints, offsets)
                g = common.mixed(_fold(tokens, edges) + sizes.astype(np.uint64))
                bits = np.zeros(len(sizes) * BITS, np.uint8)  # the counts may wrap, their parity stays
                np.add.at(bits, row * BITS + (prints >> np.uint64(53)).astype(np.int64), 1)
                bits = np.packbits((bits & 1).reshape(-1, BITS), axis=1)
                split = front_counts // max(1, crowd // 2)
                deal = np.where(front_counts > crowd, 1 + np.repeat(g, lengths) % np.maximum(split, 1).astype(np.uint64), 0).astype(np.int32)
                token_lists, part_lists, bit_rows, wide_rows = [], [], [], []
                for i in range(len(sizes)):
                    if len(groups_seen) + len(sets_seen) > SEEN:
                        groups_seen.clear()
                        sets_seen.clear()
                    first = sizes[i] > 0 and g[i] not in groups_seen
                    if first:
                        groups_seen.add(g[i])
                    token_lists.append(common.signed(tokens[edges[i]:edges[i + 1]]) if first else None)
                    part_lists.append(deal[edges[i]:edges[i + 1]] if first else None)
                    first = sizes[i] > 0 and s[i] not in sets_seen
                    if first:
                        sets_seen.add(s[i])
                    bit_rows.append(bits[i].tobytes() if first else None)
                    wide_rows.append(_wide(prints[offsets[i]:offsets[i + 1]]) if first and sizes[i] > BITS else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes.astype(np.int64)), pa.array(common.signed(s)), pa.array(common.signed(g)),
                     pa.array(bit_rows, pa.binary()), pa.array(wide_rows, pa.binary()), pa.array(token_lists, pa.list_(pa.int64())), pa.array(part_lists, pa.list_(pa.int32()))],
                    ["doc_id", "uid", "n", "s", "g", "bits", "wide", "tokens", "parts"])

    return docs.select("doc_id", "uid", "text").mapInArrow(
        rows, f"doc_id {kind}, uid long, n long, s long, g long, bits binary, wide binary, tokens array<long>, parts array<int>")


def _wide(prints: np.ndarray) -> bytes:
    """Parities of the cells that the lowest bits of a large set's fingerprints choose."""
    cells = min(WIDE_BITS, 1 << int(2 * len(prints) - 1).bit_length())
    counts = np.bincount((prints & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _odd_cells(x: bytes, y: bytes) -> int:
    """Cells in which two wide bitmaps differ; the wider one is folded first, halves on each other."""
    a, b = (np.frombuffer(v, np.uint64) for v in sorted((x, y), key=len))
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def _buckets(signed: DataFrame, percent: int) -> DataFrame:
    """`token, part, g, np, many, near` of groups that may be linked to another in a bucket.

    `np` packs size and position, `near` has the nearest groups by size that pass the filters, `many` counts
    the bucket's groups. Rows that can give no pair (nobody near, and nobody else to meet) are left out; a row of
    a dealt token stays, alone in its part or not, as it may meet those of the other parts.
    """
    entries = (signed.where("tokens is not null").select("g", "n", F.posexplode(F.arrays_zip("tokens", "parts")).alias("pos", "t"))
               .select(F.col("t.tokens").alias("token"), F.col("t.parts").alias("part"), "g", F.shiftleft("n", 32).bitwiseOR(F.col("pos")).alias("np")))
    # not by position: two groups that meet in many buckets are then the same neighbours in most
    dealt = entries.repartition("token", "part").sortWithinPartitions("token", "part", F.shiftright("np", 32), "g")
    near = pa.list_(pa.struct([("g", pa.int64()), ("np", pa.int64())]))

    def place(batches):
        for token, part, g, np_ in _buckets_of(batches):
            # one row per group, also if several tasks saw it
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (part[1:] != part[:-1]) | (g[1:] != g[:-1])
            token, part, g, np_ = token[new], part[new], g[new], np_[new]
            first = np.ones(len(token), bool)
            first[1:] = (token[1:] != token[:-1]) | (part[1:] != part[:-1])
            bucket = np.cumsum(first) - 1
            many = np.bincount(bucket)[bucket]
            n, pos = np_ >> 32, np_ & 0xFFFFFFFF
            fits, held, lists = np.zeros(len(g), bool), [], []
            for lag in range(1, NEIGHBOURS + 1):
                x, y = np.arange(lag, len(g)), np.arange(len(g) - lag)
                same = (bucket[x] == bucket[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
                x, y = x[same], y[same]
                if lag == 1:
                    fits[x], fits[y] = True, True
                least = -(-percent * (n[x] + n[y]) // (100 + percent))
                left = np.minimum(n[x] - pos[x], n[y] - pos[y]) + np.minimum(pos[x], pos[y])
                held.append((x[left >= least], y[left >= least]))
            ends, others = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
            stay = np.flatnonzero((part > 0) | (fits & ((np.bincount(ends, minlength=len(g)) > 0) | (many > NEIGHBOURS + 1))))
            order = np.argsort(ends, kind="stable")
            ends, others = ends[order], others[order]
            low, high = np.searchsorted(ends, stay), np.searchsorted(ends, stay, side="right")
            for i, a, b in zip(stay, low, high):
                lists.append([{"g": int(g[j]), "np": int(np_[j])} for j in others[a:b]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[stay]), pa.array(part[stay]), pa.array(g[stay]), pa.array(np_[stay]), pa.array(many[stay]), pa.array(lists, near)],
                ["token", "part", "g", "np", "many", "near"])

    return dealt.mapInArrow(place, "token long, part int, g long, np long, many long, near array<struct<g:long,np:long>>")


def _buckets_of(batches):
    """Arrays of whole buckets (rows of equal token and part), as they come in order."""
    rest = None
    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        if not len(rows[0]):
            continue
        if rest is not None:
            rows = [np.concatenate(x) for x in zip(rest, rows)]
        token, part = rows[:2]
        cuts = np.flatnonzero((token[1:] != token[:-1]) | (part[1:] != part[:-1]))
        cut = int(cuts[-1]) + 1 if len(cuts) else 0
        if cut:
            yield [x[:cut] for x in rows]
        rest = [x[cut:] for x in rows]
    if rest is not None:
        yield rest


def _low(np_: Column) -> Column:
    return np_.bitwiseAND(F.lit((1 << 32) - 1))


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """`a, b, token, size, room` of those `pairs(a, b, token)` of sets that their bitmaps leave possible.

    `size` counts the pair's shingles, `room` how many more could differ than are known to.
    """
    bits = classes.select("s", "n", "bits")
    wide = (pairs.join(bits.select(F.col("s").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("bits1")), "a")
            .join(bits.select(F.col("s").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("bits2")), "b"))

    def by_parity(batches):
        # each odd cell that differs is an element that only one of both sets has
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            if batch.num_rows == 0:
                continue
            x, y = (np.frombuffer(b"".join(c[f"bits{i}"].to_pylist()), np.uint64).reshape(-1, BITS // 64) for i in (1, 2))
            n = c["n1"].to_numpy() + c["n2"].to_numpy()
            least = -(-percent * n // (100 + percent))
            room = n - 2 * least - np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            keep = pa.array(room >= 0)
            yield pa.RecordBatch.from_arrays([*(c[x].filter(keep) for x in ("a", "b", "token")), pa.array(n).filter(keep), pa.array(room).filter(keep)],
                                             ["a", "b", "token", "size", "room"])

    return common.saved(wide.mapInArrow(by_parity, _LIKELY + ", room long"), "near-likely")


def _likely_large(likely: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The `likely(a, b, token, size)` pairs that the wide bitmaps, where both sets have one, leave possible too."""
    held = classes.where("wide is not null").select("s", "wide")
    pairs = likely.select("a", "b", "token", "size")
    large = (pairs.where(F.col("size") > 2 * BITS).join(held.select(F.col("s").alias("a"), F.col("wide").alias("wide1")), "a", "left")
             .join(held.select(F.col("s").alias("b"), F.col("wide").alias("wide2")), "b", "left").select("a", "b", "token", "size", "wide1", "wide2"))

    def by_parity(batches):
        for batch in batches:
            size = batch.column(3).to_numpy()
            room = size - 2 * -(-percent * size // (100 + percent))
            both = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            keep = pa.array([x is None or y is None or _odd_cells(x, y) <= r for (x, y), r in zip(both, room)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(4)], ["a", "b", "token", "size"])

    return common.saved(pairs.where(F.col("size") <= 2 * BITS).unionByName(large.mapInArrow(by_parity, _LIKELY)), "near-likely")


_LIKELY = "a long, b long, token long, size long"


def _gathered(likely: DataFrame) -> DataFrame:
    """The `likely(a, b, token, size)` pairs, with those of sets that hang together under one token.

    A set's pairs come from several buckets, and its text would travel to a place for each. Groups with more than
    `PLACE` shingles in their pairs keep their buckets' tokens.
    """
    labels = nearby(likely)
    near = (likely.select("a", "b", "token", "size").join(labels.select(F.col("s").alias("a"), F.col("c").alias("x")), "a")
            .join(labels.select(F.col("s").alias("b"), F.col("c").alias("y")), "b").withColumn("group", F.least("x", "y")).drop("x", "y"))
    near = common.saved(near, "near-groups")
    common.removed(labels)
    large = near.groupBy("group").agg(F.sum("size").alias("shingles")).where(F.col("shingles") > PLACE).select("group", F.lit(True).alias("large"))
    return near.join(large, "group", "left").select("a", "b", F.when(F.col("large"), F.col("token")).otherwise(F.col("group")).alias("token"), "size")


def _verified(docs: DataFrame, likely: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """`a, b`: the `likely(a, b, token, size)` pairs of sets that reach the threshold.

    Pairs of one `token` are checked in one place, which gets each of their texts once; a token with
    more than `PLACE` shingles in its pairs has several places.
    """
    large = likely.groupBy("token").agg(F.ceil(F.sum("size") / PLACE).alias("places")).where("places > 1")
    dealt = likely.join(large, "token", "left").select("token", F.pmod(F.xxhash64("a"), F.coalesce("places", F.lit(1))).alias("deal"), "a", "b")
    needed = (dealt.select("token", "deal", F.explode(F.array("a", "b")).alias("s")).distinct()
              .join(classes.select("s", "uid"), "s"))
    needed = common.saved(needed, "near-needed")
    # one holder of each set: its text travels, not those of its copies
    held = common.with_hit(docs, common.cell_maps(needed, "uid"), "uid", "__hit").where("__hit").join(needed, "uid")
    none, nobody = F.lit(None).cast("string"), F.lit(None).cast("long")
    rows = held.select("token", "deal", F.col("s").alias("a"), nobody.alias("b"), "text").unionByName(
        dealt.select("token", "deal", "a", "b", none.alias("text")))

    def check(batches):
        place, sets = None, {}
        for batch in batches:
            for part in common.parts(batch, limit=CHUNK):
                token, deal, a = (part.column(i).to_numpy() for i in range(3))
                paired = np.asarray(part.column(3).is_valid())
                b = part.column(3).fill_null(0).to_numpy()
                offsets, prints = shingle_sets(part.column(4), k)
                keep = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    if place != (token[i], deal[i]):
                        place, sets = (token[i], deal[i]), {}
                    if not paired[i]:
                        sets[a[i]] = prints[offsets[i]:offsets[i + 1]].copy()
                        continue
                    x, y = sets[a[i]], sets[b[i]]
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * same >= percent * (len(x) + len(y) - same)
                keep = pa.array(keep)
                yield pa.RecordBatch.from_arrays([part.column(i).filter(keep) for i in (2, 3)], ["a", "b"])

    # texts come before the pairs that need them
    sorted_ = rows.repartition("token", "deal").sortWithinPartitions("token", "deal", F.col("b").asc_nulls_first())
    links = common.saved(sorted_.mapInArrow(check, "a long, b long"), "near-links")
    common.removed(needed)
    return links


def _met(rows: DataFrame, percent: int, limit: int | None) -> DataFrame:
    """`a, b, token, size, more`: pairs of sets of one bucket and different components that size, position and bitmaps leave possible.

    Sets outside the bucket's largest component (`main`) ask, all of the bucket answer. Large buckets are
    cut into blocks, in which every asking set meets every other exactly once. A set gets the `limit` pairs whose
    bitmaps leave most room (all, if None); `more` tells that it had others.
    """
    held = ["token", "p", "q", "asks_", "s", "c", "n", "pos", "bits"]
    answer = rows.withColumns({"p": F.pmod(F.xxhash64("s"), F.col("rows")), "asks_": F.lit(False),
                               "q": F.explode(F.sequence(F.lit(0).cast("long"), F.col("asks") - 1))}).select(held)
    ask = rows.where("c <> main").withColumns({"q": F.pmod(F.xxhash64("s", F.lit(1)), F.col("asks")), "asks_": F.lit(True),
                                               "p": F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))}).select(held)
    dealt = answer.unionByName(ask).repartition("token", "p", "q").sortWithinPartitions("token", "p", "q")

    def meet(batches):
        for token, asks, s, c, n, pos, bits in _runs(batches):
            x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
            step = max(1, PAIRS // max(len(y), 1))
            for at in range(0, len(x), step):
                i, j = (g.ravel() for g in np.meshgrid(x[at:at + step], y, indexing="ij"))
                total = n[i] + n[j]
                least = -(-percent * total // (100 + percent))
                left = np.minimum(n[i] - pos[i], n[j] - pos[j]) + np.minimum(pos[i], pos[j])
                fits = (c[i] != c[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent) & (left >= least)
                i, j, room = i[fits], j[fits], (total - 2 * least)[fits]
                # each odd cell that differs is an element that only one of both sets has
                room = room - np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
                i, j, room = i[room >= 0], j[room >= 0], room[room >= 0]
                order = np.lexsort((s[j], -room, i))
                i, j = i[order], j[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                many = np.searchsorted(i, i, side="right") - np.searchsorted(i, i)
                keep = rank < (len(i) if limit is None else limit)
                more = (many > limit)[keep] if limit is not None else np.zeros(keep.sum(), bool)
                i, j = i[keep], j[keep]
                a, b = np.minimum(s[i], s[j]), np.maximum(s[i], s[j])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, token[i], n[i] + n[j], more)], ["a", "b", "token", "size", "more"])

    return dealt.mapInArrow(meet, _LIKELY + ", more boolean")


def _runs(batches):
    """The rows of each (token, p, q) of sorted batches as arrays."""
    held, key = [], None

    def arrays():
        return [np.concatenate(x) for x in zip(*held)]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
        rows = [batch.column(0).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False), *(batch.column(i).to_numpy() for i in range(4, 8)),
                np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint64).reshape(-1, BITS // 64)]
        edges = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        for a, b in zip([0, *edges], [*edges, len(keys)]):
            mine = tuple(keys[a])
            if mine != key and held:
                yield arrays()
                held = []
            key = mine
            held.append([x[a:b] for x in rows])
    if held:
        yield arrays()


def link_components(docs: DataFrame, k: int = 5, percent: int = 80, limits: tuple[int | None, ...] = LIMITS, crowd: int = HOT) -> DataFrame:
    """`doc_id, n_shingles, component_id` for every row of `docs(doc_id, text, ...)`.

    Two rows are linked if the Jaccard similarity of their sets of distinct `k`-word shingles (A-Z in
    lower case; fewer than `k` words: the whole sequence) is at least `percent` in a hundred.
    `component_id` is the smallest id reachable by links, the own one included.

    Null and empty texts and texts without words have no shingles and no links. A null id is passed over
    when the smallest is taken; the component of rows that all have null ids is null. Repeated rows are
    linked to each other. An empty table gives an empty result; other columns are ignored; texts of any
    length are read whole. Sets are compared by 64-bit fingerprints of their shingles. `limits` are the
    numbers of pairs a set asks for in each round after the first; the last, None, means all that are left.
    """
    named = _labelled(docs, k, percent, limits, crowd)
    smallest = named.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("least"), F.count("*").alias("many")).where("many > 1").drop("many")
    return (_spread_join(named, smallest).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("least")), F.col("doc_id")).alias("component_id")))


def _labelled(docs: DataFrame, k: int, percent: int, limits: tuple[int | None, ...], crowd: int) -> DataFrame:
    """`uid, doc_id, n, s, c` of every row: c is equal for linked rows with shingles."""
    common.ship(docs.sparkSession)
    # a row goes by a fingerprint of its id and text
    docs = docs.select("doc_id", "text").withColumn("uid", F.xxhash64("doc_id", "text"))
    signed = common.saved(signatures(docs, k, percent, frequent_shingles(docs, k), crowd), "near-signatures")
    classes = common.saved(signed.where("n > 0").groupBy("s").agg(F.first("n").alias("n"), F.first("g").alias("g"), F.min("uid").alias("uid"),
                                                               F.max("bits").alias("bits"), F.max("wide").alias("wide")), "near-classes")
    members = classes.select("s", "g")
    buckets = common.saved(_buckets(signed, percent), "near-buckets")
    # prefixes and bitmaps are in the buckets and classes now
    named = common.saved(signed.select("uid", "doc_id", "n", "s"), "near-named")
    common.removed(signed)

    # several sets in one group: they share the prefix, so the group is a bucket of its own
    crowded = members.groupBy("g").agg(F.count("*").alias("sets")).where("sets > 1")
    inner = members.join(crowded.select("g"), "g").join(classes.select("s", "n"), "s")
    inner = inner.select(F.col("g").alias("token"), F.lit(-1).alias("part"), "s", "n", F.lit(0).cast("long").alias("pos"))
    by_set = Window.partitionBy("token", "part").orderBy("s")
    within = inner.select("token", "s", *[F.lag("s", i).over(by_set).alias(f"b{i}") for i in range(1, NEIGHBOURS + 1)])
    within = within.select("token", F.col("s").alias("a"), F.explode(F.array(*[f"b{i}" for i in range(1, NEIGHBOURS + 1)])).alias("b")).where("b is not null")

    group_pairs = buckets.select("token", "g", F.explode("near.g").alias("g2")).groupBy("g", "g2").agg(F.min("token").alias("token"))
    pairs = (group_pairs.join(members.select(F.col("s").alias("a"), "g"), "g")
             .join(members.select(F.col("s").alias("b"), F.col("g").alias("g2")), "g2").select("a", "b", "token"))
    tested = _likely(_once(pairs.unionByName(within.select("a", "b", "token"))), classes, percent)
    labels = components(_verified(docs, _gathered(_likely_large(tested, classes, percent)), classes, k, percent))
    tested = tested.drop("room")

    # buckets with more members than have met: those outside the largest component meet the others
    large = buckets.where((F.col("many") > NEIGHBOURS + 1) | (F.col("part") > 0))
    rest = (large.select("token", "g", F.shiftright("np", 32).alias("n"), _low(F.col("np")).alias("pos"))
            .join(members, "g").select("token", "s", "n", "pos"))
    wide_groups = inner.groupBy("token").agg(F.count("*").alias("entries")).where(F.col("entries") > NEIGHBOURS + 1).select("token")
    rest = common.saved(rest.union(inner.join(wide_groups, "token").select("token", "s", "n", "pos")), "near-rest")
    common.removed(buckets)
    for limit in limits:
        placed = rest.join(labels, "s", "left").withColumn("c", F.coalesce("c", "s"))
        sizes = placed.groupBy("token", "c").agg(F.count("*").alias("many")).groupBy("token").agg(
            F.max_by("c", F.struct("many", "c")).alias("main"), F.sum("many").alias("all"), F.max("many").alias("most"))
        open_ = sizes.where("all > most").select("token", "main", F.ceil(F.col("all") / BLOCK).alias("rows"),
                                                 F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("asks"))
        met = common.saved(_met(placed.join(open_, "token").join(classes.select("s", "bits"), "s"), percent, limit), "near-met")
        # a bucket in which every set got all its pairs is done
        more = common.saved(met.where("more").select("token").distinct(), "near-more")
        fresh = common.saved(_once(met).join(tested.select("a", "b"), ["a", "b"], "left_anti"), "near-fresh")
        common.removed(met)
        if fresh.limit(1).count():
            labels = merged_labels(labels, _verified(docs, _likely_large(fresh, classes, percent), classes, k, percent))
            tested = tested.unionByName(fresh)
        if not more.limit(1).count():
            break
        rest = rest.join(more, "token", "left_semi")
    return named.join(labels, "s", "left").withColumn("c", F.coalesce("c", "s"))


def _spread_join(rows: DataFrame, by: DataFrame, spread: int = 32) -> DataFrame:
    """Left join on `c`; a component that owns a third of the rows is met in `spread` parts."""
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("doc_id", "n"), F.lit(spread)).cast("int"))
    by = by.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return rows.join(by, ["c", "deal"], "left")


def _once(pairs: DataFrame) -> DataFrame:
    """Each pair of different sets once, with the first of the buckets it met in."""
    extra = [F.first(c).alias(c) for c in pairs.columns if c == "size"]
    return (pairs.where("a <> b").withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
            .groupBy("a", "b").agg(F.min("token").alias("token"), *extra))


def op6_jaccard_join(spark, sf):
    return link_components(common.table(spark, sf, "documents"))


def near_duplicate_stage(spark, docs, sf_dir):
    """One row of each group of linked ones stays: that with the smallest id (null ids last; of equal ids the smallest fingerprint of id and text).

    Only linked rows go: rows that share an id but are not linked stay both, rows with null ids are linked by their
    texts like others. Null and empty texts and texts without words are linked with nothing and stay. Equal rows
    are linked, one stays. An empty table stays empty; other columns are kept as they are.
    """
    with common.small_batches(spark):
        rows = common.saved(_labelled(docs, 5, 80, LIMITS, HOT).where("n > 0").select("uid", "doc_id", "c"), "near-rows")
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "uid")
    best = rows.groupBy("c").agg(F.min(order).alias("best"), F.count("*").alias("many")).where("many > 1")
    # rows by fingerprint: those that go, and those that stay once of several equal ones
    equal = rows.groupBy("uid").agg(F.count("*").alias("times"), F.first("c").alias("c")).join(best, "c")
    marked = common.saved(equal.select(F.col("uid").alias("__uid"), (F.col("uid") == F.col("best.uid")).alias("__stays"), "times")
                          .where("not __stays or times > 1"), "near-marked")
    named = docs.withColumn("__uid", F.xxhash64("doc_id", "text"))
    once = named.join(marked.where("__stays").select("__uid"), "__uid", "left_semi").dropDuplicates(["__uid"])
    return named.join(marked.select("__uid"), "__uid", "left_anti").unionByName(once).select(docs.columns)
