"""Operator 4: quality rules from how a public vocabulary cuts a text.

Every word of a text is cut by a public subword vocabulary with byte fallback. Three measures of the
whole text decide: characters per token (how well the vocabulary knows these words), the share of
byte-fallback tokens (characters it does not know at all) and the entropy of the tokens in bits
against the most that so many tokens can have. Each script has bands for them; a text outside a band
is rejected. The word rules of `base` come first.

All of it is one pass inside the rows: no shuffle. A word is cut once per worker and kept in a cache
that starts afresh when full.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SYMBOLS = "#*$%&|<>"
_SYMBOL_TABLE = str.maketrans("", "", SYMBOLS)


class Band(NamedTuple):
    """What a script allows; entropy is a share of log2(tokens), judged from `entropy_from` tokens on."""

    min_chars: float
    max_chars: float
    max_bytes: float
    min_entropy: float
    max_entropy: float = 1.0
    entropy_from: int = 100


#: Bands for `piece_bpe_32k.model`, wide enough for running text of the script. Scripts whose letters
#: the vocabulary mostly lacks may be all bytes; one letter is then up to three or four tokens.
BANDS = {
    "latin": Band(1.45, 7.0, 0.05, 0.45),
    "greek": Band(0.6, 4.0, 0.4, 0.4),
    "cyrillic": Band(1.0, 6.0, 0.2, 0.4),
    "cjk": Band(0.3, 3.0, 1.0, 0.3),
    "other": Band(0.25, 4.0, 1.0, 0.3),
    "none": Band(0.8, 6.0, 0.3, 0.3),
}
#: First code points of runs of letters of one script (fixed values of the Unicode standard).
_RUNS = [(0x0000, "none"), (0x0041, "latin"), (0x005B, "none"), (0x0061, "latin"), (0x007B, "none"), (0x00C0, "latin"), (0x0250, "other"),
         (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"),
         (0x2E80, "cjk"), (0xA000, "other"), (0xAC00, "cjk"), (0xD800, "other"), (0xF900, "cjk"), (0xFB00, "other"), (0x20000, "cjk"), (0x40000, "other")]
SCRIPTS = ["latin", "greek", "cyrillic", "cjk", "other", "none"]
_STARTS = np.array([s for s, _ in _RUNS])
_NAMES = np.array([SCRIPTS.index(n) for _, n in _RUNS])


class _Vocabulary:
    """Pieces of words, cached per Python worker."""

    def __init__(self, name: str, cache_entries: int):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.size = self.model.get_piece_size()
        self.byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.cache: dict[str, bytes] = {}
        self.limit = cache_entries

    def cut(self, words: list[str]) -> list[bytes]:
        """The piece ids of each word, as bytes of 32-bit numbers."""
        get = self.cache.get
        found = list(map(get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            if len(self.cache) > self.limit:
                self.cache.clear()
            for i, ids in zip(missing, self.model.encode([words[i] for i in missing], num_threads=1)):
                found[i] = np.array(ids, np.uint32).tobytes()
                if len(words[i]) <= 64:
                    self.cache[words[i]] = found[i]
        return found


_WORKER: dict[str, _Vocabulary] = {}


def _vocabulary(name: str, cache_entries: int) -> _Vocabulary:
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = _Vocabulary(name, cache_entries)
    return _WORKER[name]


def repeated_words(row: np.ndarray, code: np.ndarray, rows: int) -> np.ndarray:
    """Per row, the words that lie in a 3-word window found twice or more in the row."""
    if len(code) < 3:
        return np.zeros(rows, np.int64)
    kinds = int(code.max()) + 1
    # ranks of word pairs first: three word codes and a row may not fit one 64-bit number
    _, pair = np.unique(code[:-2] * kinds + code[1:-1], return_inverse=True)
    _, window = np.unique(pair * kinds + code[2:], return_inverse=True)
    same = row[:-2] == row[2:]
    _, place, times = np.unique(window * rows + row[:-2], return_inverse=True, return_counts=True)
    # a window across rows is alone only by chance: count those inside rows
    inside = np.bincount(place, weights=same, minlength=len(times))
    again = same & (inside[place] >= 2)
    covered = np.zeros(len(code), bool)
    for k in range(3):
        covered[k:len(code) - 2 + k] |= again
    return np.bincount(row[covered], minlength=rows)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _scripts(texts: list[str]) -> np.ndarray:
    """The script of most letters of each text; ties go to the first in `SCRIPTS`."""
    out = np.full(len(texts), SCRIPTS.index("latin"))
    for i, text in enumerate(texts):
        if text.isascii():
            if not text.upper() != text.lower():
                out[i] = SCRIPTS.index("none")
            continue
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        counts = np.bincount(_NAMES[np.searchsorted(_STARTS, codes, side="right") - 1], minlength=len(SCRIPTS))
        out[i] = counts[:-1].argmax() if counts[:-1].any() else SCRIPTS.index("none")
    return out


def measure(texts: list[str | None], vocabulary: _Vocabulary) -> dict[str, np.ndarray]:
    """Base counts and vocabulary measures of whole texts; a null text is empty."""
    texts = [t or "" for t in texts]
    rows = len(texts)
    found = [common.WORDS.findall(t) for t in texts]
    n_words = np.array([len(f) for f in found], np.int64)
    row = np.repeat(np.arange(rows), n_words)
    code, kinds = pd.factorize(np.array([w for f in found for w in f], object))
    code = code.astype(np.int64)
    length = np.fromiter(map(len, kinds), np.int64, len(kinds))
    symbols = np.fromiter((n - len(w.translate(_SYMBOL_TABLE)) for n, w in zip(length, kinds)), np.int64, len(kinds))

    def total(per_word: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=per_word[code], minlength=rows).astype(np.int64)

    pieces = vocabulary.cut(list(kinds))
    sizes = np.fromiter((len(p) // 4 for p in pieces), np.int64, len(pieces))
    ids = np.frombuffer(b"".join(pieces), np.uint32).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    bytes_before = np.concatenate([[0], np.cumsum(vocabulary.byte[ids])]) if len(ids) else np.zeros(1, np.int64)
    n_bytes = (bytes_before[starts[1:]] - bytes_before[starts[:-1]]).astype(np.int64)
    n_tokens = total(sizes)

    # distinct words of a row with their counts, then their pieces: the token counts of the row
    per, times = np.unique(row * max(len(kinds), 1) + code, return_counts=True)
    at, kind = np.divmod(per, max(len(kinds), 1))
    many = sizes[kind]
    index = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[:-1][kind], many)
    keys = np.repeat(at, many) * vocabulary.size + ids[index]
    tokens, place = np.unique(keys, return_inverse=True)
    count = np.bincount(place, weights=np.repeat(times, many), minlength=len(tokens))
    of = tokens // vocabulary.size
    weight = np.bincount(of, weights=count * np.log2(count), minlength=rows) if len(tokens) else np.zeros(rows)
    n = np.maximum(n_tokens, 1)
    entropy = np.where(n_tokens > 1, (np.log2(n) - weight / n) / np.log2(np.maximum(n, 2)), 0.0)
    word_chars = total(length)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": total(symbols),
            "n_dup_lines": np.array([duplicate_lines(t) for t in texts], np.int64),
            "n_repeat_words": repeated_words(row, code, rows), "n_tokens": n_tokens,
            "chars_per_token": word_chars / n, "byte_share": total(n_bytes) / n, "entropy": entropy, "script": _scripts(texts)}


def judge(m: dict[str, np.ndarray], bands: dict[str, Band], min_words: int = 50, max_repeat: int = 50) -> tuple[np.ndarray, list[str | None]]:
    """Whether the base rules failed, and which band rejects the text (None: kept by the bands)."""
    failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat * m["n_words"])
    reasons: list[str | None] = []
    for s, chars, share, entropy, n in zip(m["script"], m["chars_per_token"], m["byte_share"], m["entropy"], m["n_tokens"]):
        band = bands[SCRIPTS[s]]
        if not n:
            reasons.append("no tokens")
        elif not band.min_chars <= chars <= band.max_chars:
            reasons.append("characters per token")
        elif share > band.max_bytes:
            reasons.append("byte fallback")
        elif n >= band.entropy_from and not band.min_entropy <= entropy <= band.max_entropy:
            reasons.append("token entropy")
        else:
            reasons.append(None)
    return failed, reasons


SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
          "script string, n_tokens long, chars_per_token double, byte_share double, entropy double, rejected_by string")


def fertility_rules(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", bands: dict[str, Band] | None = None,
                    cache_entries: int = 300_000) -> DataFrame:
    """`doc_id` and `SCHEMA` for every row of `docs(doc_id, text, ...)`; `kept` is false if the base or a band fails.

    Null and empty texts have no words, fail the base and are not kept. Null ids stay, repeated rows are
    each judged, an empty table gives an empty result, other columns are ignored. Texts of any length are
    read whole; a batch of long texts is worked on in slices.
    """
    common.ship(docs.sparkSession)
    bands = bands or BANDS
    docs = docs.select("doc_id", "text")
    names = ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))]

    def rate(batches):
        pieces = _vocabulary(vocabulary, cache_entries)
        for batch in batches:
            for part in common.parts(batch, limit=800_000):
                m = measure(part.column(1).to_pylist(), pieces)
                failed, reasons = judge(m, bands)
                kept = ~failed & np.array([r is None for r in reasons])
                columns = m | {"base_failed": failed, "kept": kept}
                arrays = [pa.array([SCRIPTS[s] for s in m["script"]]) if n == "script" else pa.array(reasons, pa.string()) if n == "rejected_by"
                          else pa.array(columns[n]) for n in names[1:]]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names)

    return docs.mapInArrow(rate, f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}")


def op4_fertility(spark, sf):
    return fertility_rules(common.table(spark, sf, "documents"))
