import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

from jobloom.llm import fertility as Q

SCHEMA = "doc_id long, text string, kept string, script int"
PLAIN = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} reads well enough for everyone here" for i in range(60))
TEXTS = [None, "", " \n\t", "one two", PLAIN, PLAIN + "\n" + PLAIN + "\n\n" + PLAIN, "a b c a b c d", "x\ny\nx\n\n \nx\r", "#a| <b>%& $*",
         "日本語 のテキスト " * 40, "слово за словом " * 60, "same " * 300, PLAIN * 30, "\U0001f600" * 200 + " x", "a b c\x0bd e\x85f a b c\x0bd"]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] >= 2 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))
    return (*base, len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_equals_brute_force(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(i, t, "", 0) for i, t in enumerate(TEXTS)] + [(None, PLAIN, None, None), (4, PLAIN, "", 1)]
    got = Q.fertility_rules(spark.createDataFrame(rows, SCHEMA).coalesce(1), cache_entries=5).collect()
    assert len(got) == len(rows)
    for r in got:
        text = PLAIN if r.doc_id is None else TEXTS[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), r
        ids = Counter(x for w in re.findall(r"[^\x20\x09-\x0D]+", text or "") for x in model.encode(w))
        n = sum(ids.values())
        assert r.n_tokens == n and abs(r.chars_per_token - r.word_chars / max(n, 1)) < 1e-9
        assert abs(r.byte_share - sum(c for x, c in ids.items() if model.is_byte(x)) / max(n, 1)) < 1e-9
        entropy = -sum(c / n * math.log2(c / n) for c in ids.values()) / math.log2(n) if n > 1 else 0
        assert abs(r.entropy - entropy) < 1e-9
        assert r.kept == (not r.base_failed and r.rejected_by is None)


COMMON = """the people of this small town have often said that their old river bridge was built by hand over many long years
while others believe a company from the north brought every stone along with its own workers and never asked for any money""".split()


def test_bands(spark):
    rng = np.random.default_rng(3)
    rows = [(0, " ".join(rng.choice(COMMON, 300)), "", 0), (1, " ".join(chr(0x1F300 + i) * 3 for i in range(300)), "", 0),
            (2, " ".join("qzxjv"[i % 5] + "kwqx"[i % 4] + str(i) + "%$" for i in range(300)), "", 0)]
    got = {r.doc_id: r for r in Q.fertility_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].kept and got[0].script == "latin"
    assert not got[1].kept and got[1].rejected_by == "characters per token" or got[1].rejected_by == "byte fallback"
    assert not got[2].kept and got[2].rejected_by == "characters per token"


def test_repeats_on_random_words():
    rng = np.random.default_rng(5)
    for _ in range(40):
        rows = rng.integers(1, 5)
        row = np.sort(rng.integers(0, rows, 60))
        code = rng.integers(0, 3, 60).astype(np.int64)
        want = [brute(" ".join("abc"[c] for c in code[row == r]))[4] for r in range(rows)]
        assert Q.repeated_words(row, code, int(rows)).tolist() == want


def test_empty_table_and_clean_documents(spark):
    assert Q.fertility_rules(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    got = Q.fertility_rules(docs).join(labels, "doc_id").where("not base_failed and quality = 1")
    assert got.where("not kept").count() <= 0.01 * got.count()
