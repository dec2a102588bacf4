"""Operator 9: exact token counts by a map-side two-tier lookup of pre-token lengths.

A byte-level BPE never merges across pre-tokens, so a text has the sum of its pre-tokens'
lengths. Tier one is a hash table of frequent pre-tokens, built once from a bounded sample
and broadcast; tier two is a cache in each Python worker, filled by encoding what tier one
misses. No pre-token is ever shuffled, and the tiers change the speed alone, never a count.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from . import common


#: Letters, numbers and white space below U+0250, where the faster library needs no tables.
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
#: The pre-token pattern of the vocabularies, for texts of such characters.
LATIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
NOT_LATIN = re.compile("[^\\x00-\\x1b\\x20-\u024f]")


class Lengths:
    """Token counts in one Python worker for one vocabulary file of the `tokenizers` library."""

    def __init__(self, name: str, frequent: dict[str, int], cache_entries: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.findall = regex.compile(public_tokenizers.PATTERN).findall
        self.findall_latin = LATIN_WORDS.findall
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = re.compile("|".join(re.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content))) or "(?!)")
        self.frequent, self.cache, self.limit = frequent, {}, cache_entries
        self.bytes = _byte_letters()
        self.newer = _unassigned()

    def encode(self, word: str) -> int:
        return len(self.tokenizer.model.tokenize("".join(map(self.bytes.__getitem__, word.encode()))))

    def _misses(self, words: list[str]) -> int:
        if len(self.cache) > self.limit:
            self.cache.clear()
        total, cache = 0, self.cache
        for word in words:
            n = cache.get(word)
            if n is None:
                n = self.encode(word)
                if len(word) <= 64:
                    cache[word] = n
            total += n
        return total

    def of(self, text: str | None) -> int:
        """As the library encodes `text` without added begin or end tokens."""
        if not text:
            return 0
        findall = self.findall_latin
        if NOT_LATIN.search(text):
            findall = self.findall
            if self.newer.search(text):
                # letters younger than one library's Unicode tables: let the library split the text
                return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        pieces = self.special.split(text)
        total, get = len(pieces) - 1, self.frequent.get
        for piece in pieces:
            words = findall(piece)
            known = list(map(get, words))
            if None in known:
                total += self._misses([w for w, n in zip(words, known) if n is None])
                total += sum(filter(None, known))
            else:
                total += sum(known)
        return total


def _byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _unassigned() -> re.Pattern:
    """Code points without a meaning in this Python's Unicode tables; libraries with other tables may differ on them."""
    runs, start = [], None
    for i in range(sys.maxunicode + 2):
        off = i <= sys.maxunicode and unicodedata.category(chr(i)) == "Cn"
        if off and start is None:
            start = i
        elif not off and start is not None:
            runs.append((start, i - 1))
            start = None
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


_WORKER: dict[tuple, Lengths] = {}


def _lengths(key: tuple, frequent, cache_entries: int) -> Lengths:
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Lengths(key[0], frequent(), cache_entries)
    return _WORKER[key]


def frequent_lengths(docs: DataFrame, tokenizer: str, sample_docs: int, entries: int, cache_entries: int) -> dict[str, int]:
    """Lengths of at most `entries` frequent pre-tokens of about `sample_docs` documents chosen by a hash of id and text."""
    picked = common.drawn(docs.where("text is not null"), min(1.0, sample_docs / max(docs.count(), 1)), "text")

    def count(batches):
        lengths, seen = _lengths((tokenizer, "sample"), dict, cache_entries), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for piece in lengths.special.split(text or ""):
                    seen.update(lengths.findall(piece))
            if len(seen) > 8 * entries:
                seen = Counter(dict(seen.most_common(4 * entries)))
        top = [(w, n) for w, n in seen.most_common(entries) if n > 1]
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array([w for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64()),
             "length": pa.array([lengths.encode(w) for w, _ in top], pa.int32())})

    rows = picked.mapInArrow(count, "word string, n long, length int").collect()
    seen: Counter = Counter()
    for r in rows:
        seen[r["word"]] += r["n"]
    length = {r["word"]: r["length"] for r in rows}
    return {w: length[w] for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:entries]}


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", max_tokens: int = 1024, sample_docs: int = 2_000,
                 entries: int = 50_000, cache_entries: int = 400_000) -> DataFrame:
    """`doc_id, n_bytes, n_tokens, over_limit` of every row of `docs(doc_id, text, ...)`.

    `tokenizer` names a byte-level BPE file of the tokenizers library. `sample_docs` and
    `entries` bound the broadcast table, `cache_entries` a worker's cache (it starts afresh when full).

    Null or empty texts have 0 bytes and 0 tokens. Null ids stay, repeated rows are each counted, an
    empty table gives an empty result, other columns are left out whatever their names. Very long
    texts are counted whole; pre-tokens of over 64 characters are encoded but not kept.
    """
    common.ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    context = docs.sparkSession.sparkContext
    table = context.broadcast(frequent_lengths(docs, tokenizer, sample_docs, entries, cache_entries))
    key = (tokenizer, table.id if hasattr(table, "id") else id(table))

    def count(batches):
        lengths = _lengths(key, lambda: table.value, cache_entries)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [lengths.of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                 pa.array(tokens, pa.int64()), pa.array([n > max_tokens for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark, sf):
    return token_counts(common.table(spark, sf, "documents"))
