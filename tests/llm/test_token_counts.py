import public_tokenizers
from tokenizers import Tokenizer

from jobloom.llm.token_counts import token_counts

TEXTS = [None, "", "a", "Hello, world!  It's   fine.\n\n  x", "<|endoftext|>a <|endoftext|>  b", "réeux   \t\n été 123456",
         "word " * 5000, "x" * 3000, "͸ new \U0001fae9 letters", "'re 've !'s ''s 's", " lead", "trail  ",
         "日本語のテキスト ١٢٣ ½ ²", " 　mixed space\x1c\x85!"]


def test_equals_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "y"), (None, "again", None)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), cache_entries=3)
    want = sorted((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024)
                  for i, t, _ in rows if i is not None)
    assert sorted(tuple(r) for r in got.collect() if r.doc_id is not None) == want
    assert got.where("doc_id is null").count() == 1


def test_given_table(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, sample_docs=20, entries=200).collect()}
    assert got == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}


def test_empty_table(spark):
    got = token_counts(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0 and got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_latin_pattern_equals_the_vocabulary_pattern():
    import random

    import regex

    from jobloom.llm.token_counts import LATIN_WORDS, NOT_LATIN

    pattern = regex.compile(public_tokenizers.PATTERN)
    letters = [chr(i) for i in range(0x250) if not 0x1C <= i <= 0x1F]
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice([r.choice(letters), r.choice(" \n\t'"), r.choice("stremvld09é²")]) for _ in range(40))
        assert not NOT_LATIN.search(text) and LATIN_WORDS.findall(text) == pattern.findall(text)
    assert all(NOT_LATIN.search(c) for c in "\x1c\x1f\u0250日")
