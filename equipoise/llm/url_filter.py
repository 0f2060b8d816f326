"""URL filter: a trie over reversed host labels and path segments, longest match first."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.llm.common import map_arrow

#: Rules are sent to every executor, so their number has a bound.
MAX_RULES = 1_000_000
HOST_AND_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"
Rule = tuple[str, str]


class Node:
    __slots__ = ("labels", "segments", "verdicts")

    def __init__(self):
        self.labels: dict[str, Node] = {}
        self.segments: dict[str, Node] = {}
        #: What rules that end here say, by the beginning they ask of the next segment.
        self.verdicts: dict[str, tuple[str, str]] = {}


def build_trie(rules: Iterable[tuple[str, str, str]]) -> Node:
    """A trie of (verdict, host, path) rules. For a rule that is given twice, block counts."""
    root = Node()
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        node = root
        for label in reversed(host.split(".")):
            node = node.labels.setdefault(label, Node())
        *whole, beginning = path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        if node.verdicts.get(beginning, ("", ""))[1] != "block":
            node.verdicts[beginning] = (host + path, verdict)
    return root


def longest(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """The rule with the most characters that fits; among equals one with more host labels."""
    best, best_length = None, -1
    segments = path.split("/")
    node = root
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            return best
        below = node
        for segment in segments:
            for beginning, found in below.verdicts.items():
                if segment.startswith(beginning) and len(found[0]) >= best_length:
                    best, best_length = found, len(found[0])
            below = below.segments.get(segment)
            if below is None:
                break
    return best


@lru_cache(maxsize=4)
def _trie(rules: tuple) -> Node:
    return build_trie(rules)


def filter_urls(df: DataFrame, rules: Iterable[tuple[str, str, str]], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Judge every url: ``key``, host, path, rule and verdict; nothing is shuffled.

    ``rules`` holds (verdict, host, path). A rule fits its host and all subdomains if the url's path
    starts with the rule's. The longest rule wins; without one the verdict is ``default`` and rule is
    null. A null url or one without ``://`` has empty host and path. Rows stay one to one: repeated
    and null keys are kept, other columns are ignored, an empty table gives no rows.
    """
    rules = tuple(tuple(rule) for rule in rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are sent to the executors")
    build_trie(rules)
    sent = df.sparkSession.sparkContext.broadcast(rules)
    part = lambda n: F.coalesce(F.regexp_extract(F.col(f"`{url}`"), HOST_AND_PATH, n), F.lit(""))
    parted = df.select(
        F.col(f"`{key}`").alias("page_id"),
        F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        part(2).alias("path"),
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = _trie(sent.value)
        for batch in batches:
            found = [longest(root, h, p) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)]
            rule = pa.array([f and f[0] for f in found], pa.string())
            verdict = pa.array([f[1] if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], ["page_id", "host", "path", "rule", "verdict"])

    kind = parted.schema["page_id"].dataType.simpleString()
    return map_arrow(parted, judge, f"page_id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("page_id", key)
