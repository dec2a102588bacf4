"""Operator 3: bytes covered by long repeated strings, by a sampled suffix array over all texts.

A string of `length` bytes that occurs twice has the same smallest k-gram fingerprint in both places. That
place, the anchor, is the suffix kept for all windows that share it; so two windows can only be equal
if their anchors' suffixes start alike, and some hundred windows travel as one suffix.

1. Every task writes its anchors: fingerprints of the leading k-gram and of the whole stretch of
   windows, no text. Anchors with equal stretches repeat each other in every window, whole copies too.
2. Where one leading k-gram heads different stretches (the edges of repeats), one suffix of each stretch
   travels with its text. Sampled splitters range-partition the suffixes by their leading bytes (a
   lead with very many suffixes is dealt to neighbouring ranges), each range is sorted by multikey quicksort, and equal
   windows of neighbours in that order are found.
3. The runs of a dealt lead lie in several ranges: their windows are compared across the boundaries by
   fingerprint.

Repeated bytes are united per document and cut out of the text; the runs and what is left are the
operator's results, counts and digest are derived from them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

#: Leading bytes of a suffix that choose its range: an anchor's k-gram.
LEAD = 40
PLACE_BITS = 30
#: Suffixes of one lead that are compared at a time; a lead with more is dealt to several runs, compared across.
BLOCK = 24_576


def anchors(offsets: np.ndarray, data: np.ndarray, length: int):
    """Anchors of the rows of a chunk: `(row, place, first window, last window)`, places in the chunk's bytes.

    Window i is `data[i:i + length]`; its anchor is the leftmost smallest of its k-gram fingerprints
    (by their upper bits; the lower ones hold the place, so that the left of equals is smaller).
    """
    spans = common.Spans(data)
    if len(data) < length:
        return (*[np.zeros(0, np.int64)] * 4, spans)
    grams = np.arange(len(data) - LEAD + 1)
    if len(data) >> PLACE_BITS:
        raise ValueError(f"a text of more than {1 << PLACE_BITS} bytes")
    key = spans.of(grams, grams + LEAD) >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | grams.astype(np.uint64)
    least = (_running_least(key, length - LEAD + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(len(least)), side="right") - 1
    window = np.flatnonzero(np.arange(len(least)) + length <= offsets[row + 1])
    row, place = row[window], least[window]
    start = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    end = np.append(start[1:], len(window)) - 1
    return (row[start], place[start], window[start], window[end], spans) if len(window) else (*[np.zeros(0, np.int64)] * 4, spans)


def _running_least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every run of `width` values: running minima of blocks, from both sides."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def multikey_quicksort(keys: np.ndarray) -> np.ndarray:
    """Order of rows of equal width by their columns: only rows that tie so far look at the next column."""
    order = np.argsort(keys[:, 0], kind="stable")
    tied = np.zeros(len(order), np.int64)
    tied[1:] = np.cumsum(keys[order[1:], 0] != keys[order[:-1], 0])
    for column in range(1, keys.shape[1]):
        sizes = np.bincount(tied)
        open_ = np.flatnonzero(sizes[tied] > 1)
        if not len(open_):
            break
        value = keys[order[open_], column]
        inner = np.lexsort((value, tied[open_]))
        order[open_] = order[open_][inner]
        value = value[inner]
        new = np.zeros(len(order), bool)
        new[1:] = np.diff(tied) != 0
        fresh = np.zeros(len(open_), bool)
        fresh[1:] = (value[1:] != value[:-1]) & (np.diff(tied[open_]) == 0)
        new[open_[fresh]] = True
        tied = np.cumsum(new)
    return order


def _words(segments: list[bytes], starts: np.ndarray, width: int) -> np.ndarray:
    """The bytes from `starts` on as big-endian 64-bit columns; behind the end are zeros."""
    out = np.zeros((len(segments), -(-width // 8) * 8), np.uint8)
    for i, (segment, start) in enumerate(zip(segments, starts)):
        piece = np.frombuffer(segment, np.uint8)[start:start + width]
        out[i, :len(piece)] = piece
    return out.view(">u8").astype(np.uint64)


def _window_prints(segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all windows of the segments and the segment each is of."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments], np.int64)
    starts = np.cumsum(sizes) - sizes
    many = sizes - length + 1
    of = np.repeat(np.arange(len(segments)), many)
    at = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + starts[of]
    return common.Spans(data).of(at, at + length), of


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


FOUND = "uid long, first long, last long, print long, alone boolean"


def _compare_range(length: int, block: int):
    """Sort one range of suffixes and compare the windows of equal leads.

    Gives rows `uid, first, last` for runs of windows with an equal in the range (byte places in the
    document), and for dealt leads every distinct window by `print` for the comparison across boundaries.
    """
    def compare(batches):
        frames = [b.to_pandas() for b in batches if b.num_rows]
        if not frames:
            return
        # repeated rows of a table bring the same suffix
        frame = pd.concat(frames, ignore_index=True).drop_duplicates(["uid", "first"], ignore_index=True)
        segments, at = [bytes(s) for s in frame["segment"]], frame["anchor"].to_numpy(np.int64)
        order = multikey_quicksort(_words(segments, at, length))
        frame = frame.iloc[order].reset_index(drop=True)
        segments = [segments[i] for i in order]
        lead = frame["kh"].to_numpy(np.int64)
        edges = np.flatnonzero(np.append(np.diff(lead, prepend=lead[0] - 1) != 0, True))
        # one lead is one run of the order, as its bytes are the first of the sort key
        dealt = frame["deal"].to_numpy() > 0
        blocks = [(x, min(x + block, b) if dealt[a] else b, dealt[a]) for a, b in zip(edges, edges[1:]) for x in (range(a, b, block) if dealt[a] else (a,))]
        for a, b, outer in blocks:
            prints, of = _window_prints(segments[a:b], length)
            kinds, place, times = np.unique(prints, return_inverse=True, return_counts=True)
            again = times[place] >= 2
            uid, start = frame["uid"].to_numpy()[a:b], frame["first"].to_numpy()[a:b]
            begin = np.searchsorted(of, np.arange(b - a + 1))
            rows = []
            for i in range(b - a):
                for x, y in _runs(again[begin[i]:begin[i + 1]]):
                    rows.append((int(uid[i]), int(start[i]) + x, int(start[i]) + y, 0, False))
            if outer:
                # one row for each distinct window; those alone here may have an equal in another range
                once = np.unique(place, return_index=True)[1]
                for p in once:
                    window = int(p - begin[of[p]])
                    rows.append((int(uid[of[p]]), int(start[of[p]]) + window, int(start[of[p]]) + window, int(common.signed(prints[p:p + 1])[0]), not again[p]))
            for i in range(0, len(rows), 20_000):
                columns = list(zip(*rows[i:i + 20_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.bool_()))],
                                                 ["uid", "first", "last", "print", "alone"])

    return compare


def repeated_windows(docs: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """`uid, first, last`: runs of windows (start bytes) that occur elsewhere, for `docs(uid, text)`."""
    split = max(1, block // 2)

    def find(batches):
        for batch in batches:
            for part in common.parts(batch):
                offsets, data = common.utf8(part.column(1))
                row, place, first, last, spans = anchors(offsets, data, length)
                uid = np.array(part.column(0).to_pylist(), np.int64)[row] if len(row) else np.zeros(0, np.int64)
                base = offsets[row]
                kh = common.signed(spans.of(place, place + LEAD)) if len(row) else np.zeros(0, np.int64)
                stretch = spans.of(first, last + length) if len(row) else np.zeros(0, np.uint64)
                # where the anchor lies in its stretch belongs to it
                sh = common.signed(common.mixed(stretch + (place - first).astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (uid, kh, sh, place - base, first - base, last - base)],
                                                 ["uid", "kh", "sh", "place", "first", "last"])

    found = common.saved(docs.select("uid", "text").mapInArrow(find, "uid long, kh long, sh long, place long, first long, last long"), "repeat-anchors")
    classes = common.saved(found.groupBy("kh", "sh").agg(F.count("*").alias("many"), F.min(F.struct("uid", "place", "first", "last")).alias("one")), "repeat-classes")

    # equal stretches: every window of every member occurs elsewhere
    repeated = found.join(classes.where("many > 1").select("kh", "sh"), ["kh", "sh"], "left_semi").select("uid", "first", "last")

    # different stretches behind one lead: their windows are compared
    mixed = classes.groupBy("kh").agg(F.count("*").alias("stretches")).where("stretches > 1")
    edge = classes.select("kh", "sh", "many", "one.*").join(mixed, "kh")
    needed = common.saved(edge.select("uid", "kh", "place", "first", "last", "stretches"), "repeat-edges")

    def cut(batches):
        for batch in batches:
            names = batch.schema.names
            c = {n: batch.column(i) for i, n in enumerate(names)}
            texts = c["text"].to_pylist()
            uid, kh, place, first, deal, segment = [], [], [], [], [], []
            for u, t, list_ in zip(c["uid"].to_pylist(), texts, c["wanted"].to_pylist()):
                raw = t.encode()
                for w in list_:
                    uid.append(u)
                    kh.append(w["kh"])
                    place.append(w["place"] - w["first"])
                    first.append(w["first"])
                    # a lead with up to `block` stretches is one run
                    deal.append(1 + hash((u, w["first"])) % (1 + w["stretches"] // split) if w["stretches"] > block else 0)
                    segment.append(raw[w["first"]:w["last"] + length])
            lead = [s[a:a + LEAD] for s, a in zip(segment, place)]
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(kh, pa.int64()), pa.array(lead, pa.binary()), pa.array(deal, pa.int32()),
                                              pa.array(place, pa.int64()), pa.array(first, pa.int64()), pa.array(segment, pa.binary())],
                                             ["uid", "kh", "lead", "deal", "anchor", "first", "segment"])

    wanted = needed.groupBy("uid").agg(F.collect_list(F.struct("kh", "place", "first", "last", "stretches")).alias("wanted"))
    holders = common.with_hit(docs, common.cell_maps(needed, "uid"), "uid", "__hit").where("__hit")
    segments = holders.join(wanted, "uid").select("uid", "text", "wanted").mapInArrow(
        cut, "uid long, kh long, lead binary, deal int, anchor long, first long, segment binary")
    segments = common.saved(segments, "repeat-suffixes")
    # splitters sampled from the suffixes' leading bytes; a frequent lead spreads over neighbouring ranges
    ranges = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), segments.count() // 50_000)
    ranged = segments.repartitionByRange(ranges, "lead", "deal").mapInArrow(_compare_range(length, block), FOUND)
    compared = common.saved(ranged, "repeat-compared")
    inside = compared.where("print = 0 and not alone").select("uid", "first", "last")
    # across boundaries: a window alone in its range whose print another range has too
    outer = compared.where("print <> 0")
    both = outer.groupBy("print").agg(F.count("*").alias("ranges")).where("ranges > 1").select("print")
    across = outer.where("alone").join(both, "print", "left_semi").select("uid", "first", "last")
    return repeated.union(inside).union(across)


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def remove_repeats(docs: DataFrame, length: int = 400, block: int = BLOCK, results: bool = False) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept_sha256` for every row of `docs(doc_id, text, ...)`.

    Removed is each byte of a text (UTF-8) that lies in a string of `length` bytes which also starts
    anywhere else, in the same text or another; strings are judged on the input. A null text is empty.
    With `results`, `spans` (maximal removed runs, byte places, `end` exclusive) and `kept` (the bytes that
    are left; a cut may fall inside a character) follow.
    `block` bounds the suffixes with one beginning that a task compares at a time.
    Texts shorter than `length` lose nothing. Repeated rows are repeats of each other; null ids stay; an
    empty table gives an empty result; other columns are ignored; texts are read whole (up to 1 GB each).
    A row goes by a 64-bit fingerprint of its id and text; repeated rows share it and lose the same bytes.
    """
    common.ship(docs.sparkSession)
    docs = docs.select("doc_id", "text").withColumn("uid", F.xxhash64("doc_id", "text"))
    runs = common.saved(repeated_windows(docs.where(F.octet_length("text") >= length).select("uid", "text"), length, block).distinct(), "repeat-runs")
    per = runs.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    kind = dict(docs.dtypes)["doc_id"]
    marked = common.with_hit(docs, common.cell_maps(runs, "uid"), "uid", "__hit")
    none = F.lit(None).cast("array<struct<first:bigint,last:bigint>>")
    rows = (marked.where("__hit").join(per, "uid", "left").select("doc_id", "text", "runs")
            .unionAll(marked.where("not __hit").select("doc_id", "text", none.alias("runs"))))

    def cut(batches):
        for batch in batches:
            for part in common.parts(batch):
                ids, texts, runs = (part.column(i) for i in range(3))
                sizes, spans, kept = [], [], []
                for text, own in zip(texts.to_pylist(), runs.to_pylist()):
                    raw = (text or "").encode()
                    gone = []
                    for r in own or ():
                        a, b = r["first"], r["last"] + length
                        if not gone or a > gone[-1]["end"]:  # runs that touch are one
                            gone.append({"first": a, "end": b})
                        elif b > gone[-1]["end"]:
                            gone[-1]["end"] = b
                    edges = [0, *(x for g in gone for x in (g["first"], g["end"])), len(raw)]
                    sizes.append(len(raw))
                    spans.append(gone)
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.binary())],
                                                 ["doc_id", "n_bytes", "spans", "kept"])

    left = rows.mapInArrow(cut, f"doc_id {kind}, n_bytes long, spans array<struct<first:long,end:long>>, kept binary")
    return left.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"), *(["spans", "kept"] if results else []))


def op3_substring_dedup(spark, sf):
    """The digest columns, `spans`, and `text`: what is left of each text (bytes of characters that a cut halved are U+FFFD)."""
    found = remove_repeats(common.table(spark, sf, "documents"), results=True)
    return found.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")
