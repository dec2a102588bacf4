"""Word shingles of whole texts as sets of 64-bit fingerprints."""

from __future__ import annotations

import numpy as np

from . import common

_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(texts, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct `k`-word shingles of the rows of a string column, A-Z in lower case.

    Returns offsets (one more than rows) and fingerprints, ascending inside a row. A row with fewer than
    `k` words has its whole word sequence as one shingle, a row without words has none.
    """
    offsets, data = common.utf8(texts)
    rows = len(offsets) - 1
    data = common.lowered(data)
    starts, ends, row = common.word_spans(offsets, data)
    words = common.Spans(data).of(starts, ends)
    counts = np.bincount(row, minlength=rows)
    first = np.cumsum(counts) - counts
    prints = words[:max(0, len(words) - k + 1)].copy()
    for j in range(1, k):
        prints = common.mixed(prints * _STEP + words[j:len(prints) + j])
    whole = row[:len(prints)] == row[k - 1:] if len(prints) else np.zeros(0, bool)
    prints, of = prints[whole], row[:len(prints)][whole]
    short_prints, short_rows = [], []
    for n in range(1, k):
        mine = np.flatnonzero(counts == n)
        if len(mine):
            value = words[first[mine]] + np.uint64(n)
            for j in range(1, n):
                value = common.mixed(value * _STEP + words[first[mine] + j])
            short_prints.append(common.mixed(value ^ np.uint64(n)))
            short_rows.append(mine)
    if short_rows:
        prints = np.concatenate([prints, *short_prints])
        of = np.concatenate([of, *short_rows])
        order = np.argsort(of, kind="stable")
        prints, of = prints[order], of[order]
    edges = np.searchsorted(of, np.arange(rows + 1))
    sets = [np.unique(prints[a:b]) for a, b in zip(edges, edges[1:])]
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(sets) if sets else np.zeros(0, np.uint64)
