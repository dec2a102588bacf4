"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from .decontaminate import op7_benchmark_leaks
from .fertility import op4_fertility
from .jaccard_join import op6_jaccard_join
from .language_id import op2_language_id
from .merkle import OP12_SQL, op12_merkle_manifest
from .mixing import OP8_SQL, op8_mixing
from .personal_data import op5_personal_data
from .quality_classifier import op13_quality_classifier
from .substring_dedup import op3_substring_dedup
from .token_counts import op9_token_counts
from .toxic_spans import op10_toxic_spans
from .warc import OP1_SQL, op1_warc_salvage
from .whitening import op11_whitening

QUERIES = {
    "op1_warc_salvage": op1_warc_salvage,
    "op2_language_id": op2_language_id,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_fertility": op4_fertility,
    "op5_personal_data": op5_personal_data,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_benchmark_leaks": op7_benchmark_leaks,
    "op8_mixing": op8_mixing,
    "op9_token_counts": op9_token_counts,
    "op10_toxic_spans": op10_toxic_spans,
    "op11_whitening": op11_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_quality_classifier": op13_quality_classifier,
}

ORACLES: dict[str, str] = {
    "op1_warc_salvage": OP1_SQL,
    "op8_mixing": OP8_SQL,
    "op12_merkle_manifest": OP12_SQL,
}
