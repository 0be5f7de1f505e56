"""URL filter: a trie over reversed host labels and path segments.

Rules are ``(host, path, verdict)``.  A rule fits a url when the url's host is
the rule's host or a subdomain of it and the url's path starts with the
rule's path.  The most specific rule wins: the one with the most host labels,
and among those the one with the longest path.

The trie is broadcast after a check of its size (``MAX_RULE_BYTES`` of rule
text); a larger rule list raises, as it no longer has a proven bound.  The
urls themselves are read in one pass without any shuffle.

Defined cases: a null url, or one without ``://``, has an empty host and an
empty path and fits no rule, as does an empty path where the rule has one; an
empty rule list gives the default verdict everywhere; rules that repeat with
one verdict count once, and with different verdicts ``block`` wins; repeated
rows are judged each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULE_BYTES = 8 << 20

BLOCK, ALLOW = "block", "allow"


class Trie:
    """Nodes are dicts: a host label or a path segment leads to the next node.

    ``"rule"`` holds the rules whose last path segment is still open, as
    ``(segment prefix, rule, verdict)``; segments are told from labels by the
    ``"/"`` step that ends the host.
    """

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(("host", label), {})
            node = node.setdefault("/", {})
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault(("path", segment), {})
            ends = node.setdefault("rule", {})
            if ends.get(tail, ("", ALLOW))[1] == ALLOW:
                ends[tail] = (host + path, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest matching rule as ``(rule, verdict)``."""
        node, best = self.root, None
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("host", label))
            if node is None:
                break
            # more host labels beat a longer path, so a later host level wins
            best = self._longest_path(node.get("/"), segments) or best
        return best

    @staticmethod
    def _longest_path(node: dict | None, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            if node is None:
                break
            ends = node.get("rule")
            if ends:
                fits = [tail for tail in ends if segment.startswith(tail)]
                if fits:
                    best = ends[max(fits, key=len)]
            node = node.get(("path", segment))
        return best


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(raw, upper, upper.lower())


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(df: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id",
                url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """``id, host, path, rule, verdict`` for every row; see the module's text."""
    size = sum(len(h.encode()) + len(p.encode()) for h, p, _ in rules)
    if size > MAX_RULE_BYTES:
        raise ValueError(f"{size} bytes of rules; at most {MAX_RULE_BYTES} are broadcast")
    shared = df.sparkSession.sparkContext.broadcast(Trie(rules))
    url = F.col(f"`{url_col}`")
    parts = df.select(F.col(f"`{id_col}`").alias(id_col), host_of(url).alias("host"),
                      path_of(url).alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for b in batches:
            found = [trie.find(h, p) for h, p in
                     zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            rule = pa.array([f[0] if f else None for f in found], pa.string())
            verdict = pa.array([f[1] if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), rule, verdict],
                                             names=[id_col, "host", "path", "rule", "verdict"])

    kind = parts.schema[id_col].dataType.simpleString()
    return parts.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


# The rules of the registered query.
RULES = (
    ("net", "/", BLOCK),
    ("example.net", "/en/", ALLOW),
    ("example.com", "/de/", BLOCK),
    ("org", "/fr/", ALLOW),
)

ORACLE = """
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS p FROM pages
), h AS (
  SELECT page_id,
         CASE WHEN p = 0 THEN '' ELSE
           translate(regexp_extract(substr(url, p + 3), '^[^/?#]*'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
         CASE WHEN p = 0 THEN '' ELSE
           regexp_extract(substr(url, p + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM u
), r(rhost, rpath, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), f AS (
  SELECT h.page_id, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule,
         arg_max(r.verdict, length(r.rhost || r.rpath)) AS verdict
  FROM h JOIN r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath)
  GROUP BY h.page_id
)
SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM h LEFT JOIN f ON h.page_id = f.page_id
"""
