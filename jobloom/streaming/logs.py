"""Logs that streams write batch by batch, kept short by merging closed batches in levels.

A log has a folder per run (checkpoint) and span of batches: `run=R/batch=N`, and `run=R/merged=L_A_B` for the
batches A to B after L merges. Once a level of a run holds `FAN_IN` closed spans they become one span of
the next level, so a log of n batches has at most `FAN_IN` spans per level and log(n) levels, and each row is
rewritten once per level. A merged span appears by rename, and the spans it covers go at the next merge of their run:
a reader that lists the log at any time finds every batch exactly once, and may read what it listed until the merge
after next (`FAN_IN` batches at least). A batch that may still run again
(the newest of its run) is never merged.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..sources.writers import publish

FAN_IN = 16
_FOLDER = re.compile(r"run=([^/]+)/(?:batch=(-?\d+)|merged=(\d+)_(-?\d+)_(-?\d+))$")


class Span(NamedTuple):
    run: str
    first: int
    last: int
    level: int
    path: str


def _listed(spark: SparkSession, path: str, run: str = "*") -> list[Span]:
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run={run}/*")
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for status in fs.globStatus(pattern) or []:
        at = status.getPath().toString()
        if found := _FOLDER.search(at):
            name, batch, level, first, last = found.groups()
            out.append(Span(name, int(batch if level is None else first), int(batch if level is None else last),
                            int(level or 0), at))
    return sorted(out)


def _covered(span: Span, others: list[Span]) -> bool:
    return any(o.run == span.run and o.level > span.level and o.first <= span.first and span.last <= o.last for o in others)


def spans(spark: SparkSession, path: str, run: str = "*") -> list[Span]:
    """The spans that make up the log now: every batch in exactly one of them. Empty if there is no log."""
    listed = _listed(spark, path, run)
    merged = [s for s in listed if s.level]
    return [s for s in listed if not _covered(s, merged)]


def merge_closed(spark: SparkSession, path: str, run: str, before: int, read: Callable[[list[Span]], DataFrame],
                 write: Callable[[DataFrame, str], None], fan_in: int = FAN_IN) -> int:
    """Merge full levels of one run, counting batches below `before` as closed; returns the number of merges.

    `read` gives the merged rows of neighbouring spans, `write` puts them into a new folder.
    Stopped halfway it leaves the log as it was, or with a span and those it covers, which readers tell apart.
    """
    merges, level = 0, 0
    while True:
        listed = _listed(spark, path, run)
        merged = [s for s in listed if s.level]
        full = [s for s in listed if s.level == level and s.last < before and not _covered(s, merged)][:fan_in]
        if len(full) < fan_in:
            return merges
        if merges == 0:
            _remove(spark, [s for s in listed if _covered(s, merged)])
        aside = f"{path}/_new-{uuid.uuid4().hex}"
        write(read(full), aside)
        publish(spark, aside, f"{path}/run={run}/merged={level + 1}_{full[0].first}_{full[-1].last}")
        merges, level = merges + 1, level + 1


def _remove(spark: SparkSession, old: list[Span]) -> None:
    for span in old:
        at = spark._jvm.org.apache.hadoop.fs.Path(span.path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
