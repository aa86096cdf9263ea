"""URL filtering with a trie over reversed host labels and path segments.

An entry is a host ("example.com"), which covers that host and all hosts below it, or a host with a path
("ads.example.com/track"), which covers the URLs of that very host whose path begins with its segments. A URL is judged by
the longest entry on its way through the trie: host labels from the right, then path segments. Allow entries win
over block entries of the same length. A URL that no entry covers is allowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, kind

_NAMES = ("spam-farm", "free-bets", "cheap-pills", "ads-track", "casino-win", "adult-x")
#: The production entries: (host with optional path, "allow" or "block").
ENTRIES = [(f"{name}.example.{top}", "block") for name in _NAMES for top in ("com", "net", "org")] + [
    ("ads-track.example.org/en", "allow"), ("www.cheap-pills.example.com/fr", "allow"), ("m.ads-track.example.com/de", "allow"),
    ("example.net/es", "block"), ("blog.tionsh.example.net", "allow"), ("blog.tionsh.example.net/es", "block"),
    ("m.free-bets.example.com/de/963", "allow"), ("therin.example.net", "block"), ("therin.example.net/en", "allow"),
]
BROADCAST_ENTRIES = 2_000_000
PATTERN = r"^(?i:(?:[a-z][a-z0-9+.-]*:)?//)?(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?(/[^?#]*)?(?:[?#].*)?$"
_URL = re.compile(PATTERN, re.S)
HOST, PATH = "h", "p"


def keys(url: str | None) -> list[tuple[str, str]] | None:
    """The way of a URL through the trie; None without a host. Empty path segments don't count, hosts are
    compared in lower case and without a dot at the end."""
    m = _URL.match(url.strip(" \t\r\n")) if url is not None else None
    host = m[1].lower().rstrip(".") if m else ""
    if not host or any(c in host for c in " \t\r\n"):
        return None
    labels = [(HOST, x) for x in reversed(host.split("."))]
    return labels + [(PATH, x) for x in (m[2] or "").split("/") if x]


class Trie:
    """Nodes are dictionaries; the entry that ends in a node is kept under None."""

    def __init__(self, entries: list[tuple[str, str]]):
        self.root: dict = {}
        for entry, action in entries:
            way = keys(entry)
            if way is None or action not in ("allow", "block"):
                continue
            node = self.root
            for k in way:
                node = node.setdefault(k, {})
            node[None] = min(node.get(None, (action, entry)), (action, entry))  # allow comes before block

    def find(self, url: str | None) -> tuple[str, str] | None:
        """The longest entry that covers the URL."""
        best, node = None, self.root
        for k in keys(url) or ():
            node = node.get(k)
            if node is None:
                break
            best = node.get(None, best)
        return best


def _decide(trie):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [trie.value.find(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] if f else None for f in found], pa.string()), pa.array([f[1] if f else None for f in found], pa.string())], names=["page_id", "url", "action", "entry"])

    return run


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the 128-bit digests of all beginnings of a URL's way, one chained to the other."""
    for batch in batches:
        ways = []
        for url in batch.column(1).to_pylist():
            h, way = blake2b(digest_size=16), []
            for a, b in keys(url) or ():
                h.update(f"/{a}{b}".encode("utf-8", "surrogatepass"))
                way.append(h.digest())
            ways.append(way)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ways, pa.list_(pa.binary()))], names=[*batch.schema.names, "ways"])


def filter_urls(pages: DataFrame, entries: list[tuple[str, str]] | DataFrame = ENTRIES, id_col: str = "page_id", url_col: str = "url", *, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """(page_id, url, allowed, entry) for every row of pages.

    entry is the longest that covers the URL, null without one. Ids keep their type; an empty table gives an empty
    result; long URLs are read whole; other columns are never looked at, whatever their names. Null URLs, and texts without a host, are covered by
    nothing and allowed. Repeated rows get rows of their own. Entries may be a DataFrame (entry, action); rows
    without a host or with another action are passed over, and of equal ways the allow entry, then the least text,
    counts. More than broadcast_entries are joined on the ways instead of being broadcast, with the same result.
    """
    spark = pages.sparkSession
    rows = pages.select(col(id_col).alias("page_id"), col(url_col).cast("string").alias("url"))
    if isinstance(entries, DataFrame):
        entries = entries.select("entry", "action").filter("entry IS NOT NULL AND action IN ('allow', 'block')")
        few = entries.limit(broadcast_entries + 1).collect()
        if len(few) > broadcast_entries:
            return _join(rows, entries)
        entries = [tuple(r) for r in few]
    elif len(entries) > broadcast_entries:
        return _join(rows, spark.createDataFrame(entries, "entry string, action string"))
    trie = spark.sparkContext.broadcast(Trie(entries))
    found = rows.mapInArrow(_decide(trie), f"page_id {kind(rows, 'page_id')}, url string, action string, entry string")
    return found.select("page_id", "url", (F.coalesce("action", F.lit("allow")) == "allow").alias("allowed"), "entry")


def _join(rows: DataFrame, entries: DataFrame) -> DataFrame:
    ways = entries.select("action", F.col("entry").alias("url")).mapInArrow(_prefixes, "action string, url string, ways array<binary>").filter("size(ways) > 0")
    ends = ways.groupBy(F.element_at("ways", -1).alias("way")).agg(F.min(F.struct("action", "url")).alias("best"))
    urls = rows.select("page_id", "url").filter("url IS NOT NULL").mapInArrow(_prefixes, f"page_id {kind(rows, 'page_id')}, url string, ways array<binary>")
    steps = urls.select("url", "ways").distinct().select(F.xxhash64("url").alias("u"), F.sha2("url", 256).alias("v"), F.posexplode("ways").alias("n", "way")).join(ends, "way")
    found = steps.groupBy("u", "v").agg(F.max_by("best", "n").alias("best"))
    out = rows.join(found, (F.xxhash64("url") == F.col("u")) & (F.sha2("url", 256) == F.col("v")), "left")
    return out.select("page_id", "url", (F.coalesce(F.col("best.action"), F.lit("allow")) == "allow").alias("allowed"), F.col("best.url").alias("entry"))


def oracle(entries: list[tuple[str, str]] = ENTRIES) -> str:
    values = ", ".join(f"('{e}', '{a}')" for e, a in entries)
    split = "lower(split_part(entry, '/', 1)) AS host, CASE WHEN position('/' IN entry) > 0 THEN '/' || split_part(entry, '/', 2) || CASE WHEN split_part(entry, '/', 3) <> '' THEN '/' || split_part(entry, '/', 3) ELSE '' END ELSE '' END AS path"
    return f"""
WITH entries AS (SELECT entry, action, {split} FROM (VALUES {values}) AS e(entry, action)),
parts AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS h, regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)?', 1) AS p FROM pages),
hits AS (SELECT page_id, url, entry, action, row_number() OVER (PARTITION BY page_id ORDER BY len(string_split(host, '.')) + len(string_split(path, '/')) - 1 DESC, action, entry) AS r
FROM parts JOIN entries ON path = '' AND (h = host OR ends_with(h, '.' || host)) OR path <> '' AND h = host AND (p = path OR starts_with(p, path || '/')))
SELECT page_id, url, coalesce(action, 'allow') = 'allow' AS allowed, entry FROM pages LEFT JOIN (SELECT page_id, entry, action FROM hits WHERE r = 1) USING (page_id)"""
