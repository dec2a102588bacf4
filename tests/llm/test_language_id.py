import zlib

import numpy as np
from pyspark.sql import functions as F

from jobloom.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, source string, score string, lang_pred int"
ENGLISH, GERMAN = "the thing that was there is with them", "der und die nicht schön für ein straße"


def brute(text, d=L.DIMENSIONS):
    """Letter by letter, n-gram by n-gram."""
    letters = []
    for ch in (text or "").lower():
        if ch.isalpha():
            letters.append(ch)
        elif not letters or letters[-1] != " ":
            letters.append(" ")
    letters = ([] if letters[:1] == [" "] else [" "]) + letters + ([] if letters[-1:] == [" "] else [" "])
    out = np.zeros(d)
    if not any(ch.isalpha() for ch in letters):
        return out
    vector = lambda ch: L._letter_vectors(np.array([ord(ch)]), d)[0]
    for i in range(len(letters) - 2):
        out += np.roll(vector(letters[i]), 2) * np.roll(vector(letters[i + 1]), 1) * vector(letters[i + 2])
    return out


def test_vectors_equal_brute_force():
    texts = ["Hello,  wörld!", None, "", "  12 ", "a", "ΑΒγ 日本", "!x1y?", "ab\ncd" * 40, "ẞ İ"]
    got, has = L.document_vectors(texts)
    for t, v, h in zip(texts, got, has):
        assert np.allclose(v, brute(t)) and h == any(c.isalpha() for c in t or "")
    assert np.allclose(L.document_vectors(texts[::-1])[0][::-1], got)


def test_predictions_and_edges(spark):
    rows = [(i, ENGLISH if i % 2 else GERMAN, "en" if i % 2 else "de", "s", "", 0) for i in range(40)]
    rows += [(100, None, "en", None, None, None), (101, "", "de", "", "", 0), (102, "42 !", "en", "", "", 0),
             (103, "those thinner things", None, "", "", 0), (None, ENGLISH * 300, None, None, None, None), (103, "schöne für", None, "", "", 0)]
    got = [tuple(r) for r in L.identify(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(rows)
    by = {(i, s > 0): (p, s) for i, h, p, s in got}
    assert all(p == ("en" if i % 2 else "de") for i, _, p, _ in got if i is not None and i < 40)
    assert all(by[(i, False)] == ("und", 0.0) for i in (100, 101, 102))
    assert sorted(p for i, _, p, _ in got if i == 103) == ["de", "en"] and by[(None, True)][0] == "en"
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h, _, _ in got if i is not None)
    assert all(0 <= s <= 1 for *_, s in got)


def test_nothing_learned_and_empty(spark):
    got = L.identify(spark.createDataFrame([(1, "text", None, "", "", 0)], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert L.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg(F.expr("cast(lang = lang_pred as int)"))).first()[0] >= 0.97


def test_stage_keeps_columns(spark):
    rows = [(1, ENGLISH, "en", "s", "", 0), (2, "...", "en", "s", "", 0), (3, GERMAN, "de", "s", "", 0), (4, GERMAN, None, "s", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = L.language_stage(spark, docs, "")
    assert got.columns == docs.columns and sorted((r.doc_id, r.lang) for r in got.collect()) == [(1, "en"), (3, "de"), (4, "de")]


def test_memory_of_many_short_texts():
    import tracemalloc

    texts = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(10_000)]
    L.document_vectors(texts[:10])
    tracemalloc.start()
    vectors, _ = L.document_vectors(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
    assert np.array_equal(vectors[::997], np.concatenate([L.document_vectors([t])[0] for t in texts[::997]]))


def test_stage_sends_each_text_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some plain words of text", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    sent, send = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, *rest: sent.append(self.columns) or send(self, *rest))
    from jobloom.llm.language_id import language_stage

    assert [r.doc_id for r in language_stage(spark, docs, "").collect()] == [1]
    assert sent[-1] == docs.columns
