"""Operator 2: language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (from its code point). An n-gram's vector binds the
letters' vectors, each permuted by its place, by multiplication; a document's vector bundles the
vectors of its n-grams by addition, a language's prototype bundles documents scaled to length one.
A document has the language whose prototype has the largest cosine with its vector.

Training sums document vectors per language on the executors; only one vector per language and task
leaves them. Prediction is one pass over the texts with the prototypes broadcast.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common

DIMENSIONS = 512
N = 3
#: n-grams whose vectors are held at a time.
BLOCK = 2048
#: Texts that are counted against a block of n-grams at a time, so that the counts have a million cells at most.
ROWS = 512
SPACE = 0x20


@functools.cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _letter_vectors(letters: np.ndarray, dimensions: int) -> np.ndarray:
    """Rows of +1 and -1, one for each code point, the same in every process."""
    lanes = np.arange(dimensions // 64, dtype=np.uint64) + np.uint64(1)
    words = common.mixed(letters.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + lanes[None, :] * np.uint64(0xD1B54A32D192ED03))
    bits = np.unpackbits(words.view(np.uint8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def document_vectors(texts: list[str | None], dimensions: int = DIMENSIONS, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Vectors (rows) of whole texts, and whether each has a letter. Letters count in lower case; whatever
    lies between letters counts as one space, also before the first and after the last."""
    if len(texts) > ROWS:
        pieces = [document_vectors(texts[i:i + ROWS], dimensions, n) for i in range(0, len(texts), ROWS)]
        return np.concatenate([v for v, _ in pieces]), np.concatenate([h for _, h in pieces])
    places = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) + n - 1 for p in places])
    row = np.repeat(np.arange(len(texts)), sizes)
    codes = np.full(int(sizes.sum()), SPACE, np.uint32)
    at = 0
    for p, size in zip(places, sizes):
        codes[at + 1:at + 1 + len(p)] = p
        at += size
    letter = _is_letter()[codes]
    codes[~letter] = SPACE
    fresh = np.ones(len(codes), bool)
    fresh[1:] = letter[1:] | letter[:-1] | (row[1:] != row[:-1])
    codes, row, letter = codes[fresh], row[fresh], letter[fresh]
    has_letter = np.zeros(len(texts), bool)
    has_letter[row[letter]] = True
    out = np.zeros((len(texts), dimensions), np.float32)
    if len(codes) < n or not has_letter.any():
        return out, has_letter
    whole = (row[n - 1:] == row[:len(row) - n + 1]) & has_letter[row[:len(row) - n + 1]]
    symbols = np.flatnonzero(np.bincount(codes))
    dense = np.searchsorted(symbols, codes).astype(np.int64)
    grams = np.zeros(len(codes) - n + 1, np.int64)
    for k in range(n):
        grams = grams * len(symbols) + dense[k:len(dense) - n + 1 + k]
    grams, row = grams[whole], row[:len(whole)][whole]
    kinds, place = np.unique(grams, return_inverse=True)
    letters = _letter_vectors(symbols, dimensions)
    permuted = [np.roll(letters, n - 1 - k, axis=1) for k in range(n)]
    order = np.argsort(place // BLOCK, kind="stable")
    row, place = row[order], place[order]
    edges = np.searchsorted(place // BLOCK, np.arange((len(kinds) - 1) // BLOCK + 2))
    for b in range(len(edges) - 1):
        mine = kinds[b * BLOCK:(b + 1) * BLOCK]
        vectors = np.ones((len(mine), dimensions), np.float32)
        rest = mine
        for k in range(n - 1, -1, -1):
            rest, last = np.divmod(rest, len(symbols))
            vectors *= permuted[k][last]
        r, p = row[edges[b]:edges[b + 1]], place[edges[b]:edges[b + 1]] - b * BLOCK
        counts = np.bincount(r * len(mine) + p, minlength=len(texts) * len(mine)).reshape(len(texts), len(mine))
        out += counts.astype(np.float32) @ vectors
    return out, has_letter


def _unit_rows(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1, length)


def train(docs: DataFrame, trained_on: Column, train_docs: int = 20_000, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and prototypes (unit rows) learned from `docs(text, lang)` where `trained_on` holds.

    Of more than `train_docs` such rows, a sample of about that many is chosen by a hash of id and text, each row once.
    """
    common.ship(docs.sparkSession)
    rows = docs.where(trained_on & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = min(1.0, train_docs / max(rows.count(), 1))
    rows = common.drawn(rows, share, "text", "lang")

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in common.parts(batch, limit=400_000):
                vectors = _unit_rows(document_vectors(part.column(0).to_pylist(), dimensions)[0])
                langs = np.array(part.column(1).to_pylist(), object)
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]},
                                             schema=pa.schema([("lang", pa.string()), ("vector", pa.list_(pa.float64()))]))

    totals = (rows.mapInArrow(bundle, "lang string, vector array<double>").select("lang", F.posexplode("vector"))
              .groupBy("lang", "pos").agg(F.sum("col").alias("value"))
              .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v")).orderBy("lang").collect())
    prototypes = np.array([[x.value for x in r.v] for r in totals]).reshape(len(totals), dimensions)
    return [r.lang for r in totals], _unit_rows(prototypes)


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray, keep: list[str],
            into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`keep` columns of `docs` with the prediction and its score, the cosine (0 to 1) of the nearest prototype.

    A text that is null or has no letter, and any text if nothing was learned, is `und` with score 0.
    Ties go to the first language in code point order.
    """
    common.ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((languages, prototypes.astype(np.float32)))
    # a text that is kept travels once
    inner = docs.select(*keep, *(["text"] if "text" not in keep else []))
    schema = inner.select(*keep).schema.add(into[0], "string").add(into[1], "double")

    def label(batches):
        languages, prototypes = model.value
        for batch in batches:
            for part in common.parts(batch, limit=400_000):
                vectors, has_letter = document_vectors(part.column(part.schema.names.index("text")).to_pylist(), prototypes.shape[1])
                cosines = _unit_rows(vectors) @ prototypes.T if languages else np.zeros((len(vectors), 1))
                best = cosines.argmax(axis=1)
                known = has_letter & bool(languages)
                score = np.where(known, np.clip(cosines.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    part.columns[:len(keep)] + [pa.array([languages[b] if k else "und" for b, k in zip(best, known)], pa.string()),
                                         pa.array(score, pa.float64())], schema.names)

    return inner.mapInArrow(label, schema)


def held_out(mod: int = 5, rest: int = 0) -> Column:
    return F.pmod(F.crc32(common.id_text("doc_id").cast("binary")), F.lit(mod)) == rest


def identify(docs: DataFrame, train_docs: int = 20_000) -> DataFrame:
    """`doc_id, held_out, lang_pred, score` of every row of `docs(doc_id, text, lang, ...)`.

    Prototypes come from rows that are not held out (crc32 of the id as text, mod 5, is 0; a null id
    counts as empty text) and have text and language. Language, source and id play no part in a
    prediction. Empty tables give empty results; repeated rows get equal answers; texts of any length
    are read whole; other columns are ignored.
    """
    docs = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out())
    languages, prototypes = train(docs, ~F.col("held_out"), train_docs)
    return predict(docs, languages, prototypes, ["doc_id", "held_out"])


def op2_language_id(spark, sf):
    return identify(common.table(spark, sf, "documents"))


def language_stage(spark, docs, sf_dir):
    """Documents in a recognised language, labelled with it where they had no label; the others go.

    Not recognised (`und`) are texts that are null, empty or without a letter, and, where no row has text and
    label to learn from, all texts. Any other text has a nearest prototype and stays, as clean text must.
    Null ids and repeated rows stay; an empty table stays empty; other columns are kept as they are.
    """
    languages, prototypes = train(docs.select("doc_id", "text", "lang"), F.lit(True))
    found = predict(docs, languages, prototypes, docs.columns, ("__language", "__cosine"))
    return found.where("__language <> 'und'").withColumn("lang", F.coalesce("lang", "__language")).select(docs.columns)
