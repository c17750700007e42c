"""URL filters: prefix rules joined to urls by a sorted sweep.

A rule has a host and a path; it fits urls of its host and of all subdomains whose path starts with the rule's.
Host labels in reverse order, each closed by a dot, make a key in which the subdomains of a host are the keys
that its own key begins: an interval. Rules and urls are dealt to key ranges, a rule to every range that its
interval meets, and each task sweeps its sorted rows with a stack of the rules whose interval is open. A url
looks through the open rules only. The range bounds come from a bounded sample of the urls and decide where
rows go, never what they get; as the key ends with the path and a hash of the row, a hot host falls into many
ranges.

Of several fitting rules the longest (host and path together) wins, then the one with the longer host, then
``block``. A url without ``://`` or a null url has an empty host and path, which no rule fits, and gets the
default verdict; so does a url that no rule fits. Every row gives one row, repeated ones too. An empty rule
table leaves the default everywhere. Other columns of the urls stay, except ``host``, ``path``, ``rule`` and
``verdict``, which are replaced.
"""

from __future__ import annotations

import string
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.batches import schema_with, with_columns

AFTER_SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Sampled urls for each range; only the evenness of the ranges depends on it.
SAMPLES_PER_RANGE = 20


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_host(url: Column) -> Column:
    """What stands between ``://`` and the first ``/``, ``?`` or ``#``, A-Z in lower case; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, AFTER_SCHEME, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, AFTER_SCHEME, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each closed by a dot: ``www.example.com`` gives ``com.example.www.``."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


HELPERS = ("range", "key", "is_rule", "rule", "rule_path", "rule_verdict", "first", "last")


def _ranges(bounds: list[bytes], own: dict[str, str]):
    """A batch function that adds the ranges which a row's key interval meets; ``own`` names the helper columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [k.encode() for k in batch.column(own["key"]).to_pylist()]
            rules = batch.column(own["is_rule"]).to_pylist()
            first = [bisect_right(bounds, k) for k in keys]
            last = [bisect_right(bounds, k + b"\xff") if rule else at for k, rule, at in zip(keys, rules, first)]
            yield with_columns(batch, {own["first"]: pa.array(first, pa.int32()), own["last"]: pa.array(last, pa.int32())})

    return run


class OpenRules:
    """The rules of one host while the sweep is inside its interval: by path, and the lengths to try."""

    def __init__(self, key: str):
        self.key = key
        self.by_path: dict[str, tuple[str, str]] = {}
        self.lengths: list[int] = []

    def add(self, path: str, rule: str, verdict: str) -> None:
        if path not in self.by_path or verdict == "block":
            self.by_path[path] = (rule, verdict)
            self.lengths = sorted({len(p) for p in self.by_path}, reverse=True)

    def best(self, path: str) -> tuple[str, str] | None:
        for length in self.lengths:
            if length <= len(path) and (found := self.by_path.get(path[:length])):
                return found
        return None


def _sweep(default: str, columns: list[str], own: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[OpenRules] = []
        at = None
        for batch in batches:
            rules, verdicts, keep = [], [], []
            names = (*(own[name] for name in HELPERS[:6]), "path")
            rows = zip(*(batch.column(name).to_pylist() for name in names))
            for n, (place, key, is_rule, rule, rule_path, rule_verdict, path) in enumerate(rows):
                if place != at:
                    at, stack = place, []
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if is_rule:
                    if not stack or stack[-1].key != key:
                        stack.append(OpenRules(key))
                    stack[-1].add(rule_path, rule, rule_verdict)
                    continue
                best = None
                for level in reversed(stack):
                    found = level.best(path)
                    if found and (best is None or len(found[0]) > len(best[0])):
                        best = found
                keep.append(n)
                rules.append(best[0] if best else None)
                verdicts.append(best[1] if best else default)
            kept = batch.take(pa.array(keep, pa.int64()))
            made = with_columns(kept, {"rule": pa.array(rules, pa.string()), "verdict": pa.array(verdicts, pa.string())})
            yield made.select(columns)

    return run


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, the winning ``rule`` and its ``verdict`` to every url.

    ``rules`` has the columns ``host``, ``path`` and ``verdict`` (``allow`` or ``block``).
    """
    session = urls.sparkSession
    width = int(session.conf.get("spark.sql.shuffle.partitions"))
    mark = uuid.uuid4().hex
    own = {name: f"_{name}_{mark}" for name in HELPERS}
    parts = urls.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))}).drop("rule", "verdict")
    place = F.concat_ws("\0", host_key(F.col("host")), F.col("path"), F.hex(F.xxhash64(*(F.col(f"`{c}`") for c in parts.columns))))
    pages = parts.withColumns({own["key"]: place, own["is_rule"]: F.lit(False)})
    lists = rules.select(
        host_key(lower_ascii(F.col("host"))).alias(own["key"]),
        F.lit(True).alias(own["is_rule"]),
        F.concat(lower_ascii(F.col("host")), F.col("path")).alias(own["rule"]),
        F.col("path").alias(own["rule_path"]),
        F.col("verdict").alias(own["rule_verdict"]),
    )
    sample = pages.select(own["key"]).orderBy(F.xxhash64(own["key"]), own["key"]).limit(width * SAMPLES_PER_RANGE)
    drawn = sorted(r[0].encode() for r in sample.collect())
    bounds = drawn[SAMPLES_PER_RANGE::SAMPLES_PER_RANGE]
    both = pages.unionByName(lists, allowMissingColumns=True)
    ranged = both.mapInArrow(_ranges(bounds, own), schema_with(both, f"{own['first']} int, {own['last']} int"))
    dealt = ranged.withColumn(own["range"], F.explode(F.sequence(own["first"], own["last"]))).drop(own["first"], own["last"])
    swept = dealt.repartition(own["range"]).sortWithinPartitions(own["range"], own["key"], F.desc(own["is_rule"]))
    judged = schema_with(parts, "rule string, verdict string")
    return swept.mapInArrow(_sweep(default, [*parts.columns, "rule", "verdict"], own), judged)
