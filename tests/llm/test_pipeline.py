import re

import corpus_pipeline
from jobloom.llm import personal_data as P
from jobloom.llm.language_id import identify, train
from jobloom.session import fresh_path

from .test_decontaminate import D
from .test_jaccard_join import brute as linked
from .test_mixing import brute_targets

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    docs, rows = raw, {r.doc_id: r for r in raw.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "mixing":
            assert out.columns == raw.columns
        path = fresh_path(spark, "pipeline-test")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        got = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            assert set(got) == {i for i, r in rows.items() if any(c.isalpha() for c in r.text or "")}
        elif name == "near_duplicates":
            assert set(got) == {i for i, n, c in linked([(i, r.text) for i, r in rows.items()]) if i == c or not n}
        elif name == "decontamination":
            exact = {i for i, r in rows.items() if any(b.text in r.text for b in benchmark)}
            assert not exact & set(got) and len(set(rows) - set(got)) <= len(exact) + 1
        elif name == "personal_data":
            assert set(got) == set(rows) and not any(P.base_spans(r.text) for r in got.values())
            assert all(r.text == rows[i].text for i, r in got.items() if not P.TRIGGER.search(rows[i].text))
        else:
            sizes, taken, biggest = {}, {}, {}
            for i, r in rows.items():
                n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
                sizes[r.source] = sizes.get(r.source, 0) + n
                biggest[r.source] = max(biggest.get(r.source, 0), n)
                taken[r.source] = taken.get(r.source, 0) + n * (got[i].copies if i in got else 0)
            want = brute_targets(sizes)
            assert all(abs(taken[s] - want[s]) <= biggest[s] / 2 for s in sizes) and all(r.copies in (1, 2) for r in got.values())
        rows = got
