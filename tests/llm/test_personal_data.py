import hashlib
import itertools
import random
import re
import tracemalloc

import numpy as np
import pytest

from jobloom.llm import personal_data as P

SCHEMA = "doc_id long, text string, spans string, n_ip int, n_chars long"
PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            if kind == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == 2 and not (13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0):
                continue
            if kind == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


TEXTS = [None, "", "nothing here", "mail a.b@c-d.org, x@y@z.com a@b.c@d.e a@b..c @x.y a@.b é@x.com", "1.2.3.4 1.2.3.4.5 256.1.1.1 1.2.3 0.0.0.0 1.2.3.0255",
         "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111 5500000000000004", "+1 (132) 555-1352 +49 30 1 +123456789012345678 ++4915112345678.",
         "x" * 50000 + "@", "1" * 30000, "ü 😀 a@b.co 😀 +49 30 123456-78"]


def test_patterns_equal_brute_force():
    for text in TEXTS[:7] + TEXTS[9:]:
        assert P.base_spans(text or "") == brute(text), text
    r = random.Random(3)
    for _ in range(4000):
        text = "".join(r.choice("ab@..-+ 1234(5)9") for _ in range(r.randint(0, 30)))
        assert P.base_spans(text) == brute(text), text
    assert P.base_spans(TEXTS[7]) == [] and P.base_spans(TEXTS[8]) == []


def test_crf_and_lstm_gradients(monkeypatch):
    monkeypatch.setattr(P, "HIDDEN", 3)
    rng = np.random.default_rng(0)
    network = P.Network(*(w.astype(np.float64) for w in P.fresh(rng)))
    x, y = rng.integers(0, P.SYMBOLS, (7, 2)), rng.integers(0, P.TAGS, (7, 2))
    # the loss is the negative log of the share of the true tag sequence among all
    short = P.tag_scores(network, x[:3])
    total = np.zeros(2)
    for tags in itertools.product(range(P.TAGS), repeat=3):
        total += np.exp(network.start[tags[0]] + sum(short[t, :, k] for t, k in enumerate(tags)) + sum(network.transition[a, b] for a, b in zip(tags, tags[1:])))
    gold = network.start[y[0]] + sum(short[t, np.arange(2), y[t]] for t in range(3)) + sum(network.transition[y[t], y[t + 1]] for t in range(2))
    assert P.gradients(network, x[:3], y[:3])[0] == pytest.approx(float((np.log(total) - gold).sum()), rel=1e-4)
    _, grads = P.gradients(network, x, y)
    for k, (w, g) in enumerate(zip(network, grads)):
        at = np.unravel_index(int(np.abs(g).argmax()), g.shape)
        up, down = w.copy(), w.copy()
        up[at] += 1e-2
        down[at] -= 1e-2
        slope = (P.gradients(network._replace(**{P.Network._fields[k]: up}), x, y)[0]
                 - P.gradients(network._replace(**{P.Network._fields[k]: down}), x, y)[0]) / 2e-2
        assert slope == pytest.approx(float(g[at]), rel=2e-2, abs=1e-3)


def test_reading_holds_no_gates():
    # 512 windows took 150 MB when what the way back needs was kept too
    network = P.fresh(np.random.default_rng(1))
    texts = ["call 1 " + "a" * 300] * 512
    tracemalloc.start()
    P.decode(network, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70e6
    x = np.random.default_rng(2).integers(0, P.SYMBOLS, (P.WINDOW, 5))
    assert np.array_equal(P.tag_scores(network, x), P.tag_scores(network, x, keep=True)[0])


def test_windows_cover_triggers():
    text = "a" * 300 + "7" + "b" * 100 + "@" + "c" * 500 + "1" * 400
    covered = set()
    for a, b in P.windows(text):
        assert b - a <= P.WINDOW
        covered.update(range(a, b))
    want = {i for m in P.TRIGGER.finditer(text) for i in range(max(0, m.start() - P.REACH), min(len(text), m.end() + P.REACH))}
    assert covered == want


def test_query_and_redaction(spark):
    base = [(i, t, "", 0, 5) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None, None), (None, "a@b.co", None, None, None),
                                                            (20, "write to mary.smith (at) example (dot) org today", "", 0, 1),
                                                            (21, "words " * 20000 + "a@b.co", "", 0, 1)]
    sample = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id + 1000 doc_id", "text", "'' spans", "0 n_ip", "n_chars")
    docs = spark.createDataFrame(base, SCHEMA).unionByName(sample).cache()
    network = P.train_on(docs)
    got = P.personal_data(docs, network=network).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        want = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == s[0] for s in want) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        spans = [(P.KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert spans == sorted(spans) and set(want) <= set(spans) and len(spans) == len(want) + r.n_added
    # the network adds little to a corpus whose personal data is written plainly
    assert sum(r.n_added for r in got if r.doc_id and r.doc_id >= 1000) <= 2
    clean = P.redact(docs, network=network)
    assert clean.columns == docs.columns
    clean = {r.doc_id: r for r in clean.collect()}
    assert clean[9].text == "ü 😀 <email> 😀 <phone>" and clean[0].text is None and clean[2].text == TEXTS[2]
    assert P.personal_data(docs.limit(0), network=network).count() == 0


def test_nothing_to_learn_from(spark):
    got = P.personal_data(spark.createDataFrame([(1, "no digits", "", 0, 0), (2, None, "", 0, 0)], SCHEMA)).collect()
    assert [(r.spans, r.n_added) for r in got] == [("", 0)] * 2


def test_learns_written_around_spans():
    rng = np.random.default_rng(7)
    network = P.train(["some plain running text without any such thing in it, only words " * 8], steps=150, made=3000)
    text = "only words and plain running text without any such thing in it and some more of it, as long as a window is, so that it can be cut somewhere "
    found = total = 0
    for _ in range(160):
        kind, value = (k := int(rng.integers(0, 4))), P.written(rng, k)
        whole = text + value + " " + text
        base, added = P.find(network, [whole])[0]
        span = (kind, len(text), len(text) + len(value))
        total += span not in base
        found += span in added
    assert found >= 0.6 * total
    assert all(not added for _, added in P.find(network, [text + P.harmless(rng) + " " + text for _ in range(100)]))
