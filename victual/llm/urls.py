"""URL filters: a broadcast trie over reversed host labels and path segments.

A rule has a host, a path prefix and a verdict.  It fits its host and all
subdomains, if the url's path starts with the rule's; of those that fit the
longest host wins, then the longest path.  A url is judged by one walk down
the host labels from the last to the first, and in each node passed a walk
along its path segments.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, utf8

#: The registered query's rules: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DEFAULT = "allow"
#: More rules than this are not broadcast but refused: a trie of so many fills an executor.
MOST_RULES = 2_000_000


class Trie:
    """Nested dicts: label -> node; a node's "" entry is the trie of its rules' path segments.

    In a path trie a segment leads on, and the "" entry lists (start of the
    last segment, rule, verdict), longest first, as a prefix may end within a
    segment.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]], default: str = DEFAULT):
        self.root: dict = {}
        self.default = default
        seen: dict[tuple[str, str], str] = {}
        for host, path, verdict in rules:
            host = host.lower()
            if seen.get((host, path)) == "block":  # of a rule given twice, block stands
                continue
            seen[host, path] = verdict
        for (host, path), verdict in seen.items():
            node = self.root
            for label in reversed(host.split(".") if host else []):
                node = node.setdefault(label, {})
            *whole, last = path.split("/")
            at = node.setdefault("", {})
            for segment in whole:
                at = at.setdefault("/" + segment, {})
            at.setdefault("", []).append((last, host + path, verdict))
        self._order(self.root)

    def _order(self, start: dict) -> None:
        stack = [start]
        while stack:
            for key, value in stack.pop().items():
                if isinstance(value, dict):
                    stack.append(value)
                else:
                    value.sort(key=lambda x: -len(x[0]))

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """The rule that decides (or None) and the verdict."""
        found: tuple[str | None, str] = (None, self.default)
        segments = path.split("/")
        node = self.root
        labels = reversed(host.split(".")) if host else iter(())
        while True:
            if (at := node.get("")) is not None:
                best = None
                for segment in segments:
                    best = next(((rule, verdict) for last, rule, verdict in at.get("", ()) if segment.startswith(last)), best)
                    if (at := at.get("/" + segment)) is None:
                        break
                found = best or found
            label = next(labels, None)
            if not label or (node := node.get(label)) is None:  # an empty label fits no rule
                return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.encode().lower().decode(), slash + path


def _judge(trie, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    judge = trie.value.judge
    for batch in batches:
        parts = [split_url(u.as_buffer().to_pybytes().decode()) for u in batch.column("_url")]
        found = [judge(*x) for x in parts]
        extra = [pa.array(c, pa.string()) for c in ([x[0] for x in parts], [x[1] for x in parts], [x[0] for x in found], [x[1] for x in found])]
        names = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *extra], names=[*names, "host", "path", "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each row of ``pages(page_id, url)``.

    A null url, or one without ``://``, has an empty host and path; no rule
    fits and ``default`` is the verdict.  Repeated rows are judged each on its
    own, an empty table gives an empty result, extra columns are ignored.  Urls of any
    length are judged whole.  Of rules with one host and path a block stands.
    """
    rules = list(rules)
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules are more than {MOST_RULES}, the most that are broadcast")
    spark = pages.sparkSession
    bounded_batches(spark)
    trie = spark.sparkContext.broadcast(Trie(rules, default))
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", utf8("url").alias("_url"))
    return rows.mapInArrow(lambda batches: _judge(trie, batches), f"page_id {kind}, host string, path string, rule string, verdict string")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; see ``judge_urls`` for the edge cases."""
    return judge_urls(table(spark, sf_dir, "pages"))


_FITS = " ".join(
    f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{host}{path}|{verdict}'"
    for host, path, verdict in sorted(RULES, key=lambda r: (-r[0].count("."), -len(r[0]), -len(r[1])))
)
OP6_SQL = f"""
WITH r AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), l AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h
), f AS (
  SELECT *, CASE {_FITS} END AS fit FROM l
)
SELECT page_id, host, path, split_part(fit, '|', 1) AS rule, coalesce(split_part(fit, '|', 2), '{DEFAULT}') AS verdict FROM f
"""
