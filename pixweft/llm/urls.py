"""URL filters: site rules, and pattern rules behind an index of rare tokens.

A url's tokens are its runs of a-z and 0-9, lower-cased. Each pattern rule names tokens that
every url it matches must have; it is filed under the one that is rarest in the table at
hand. A url's tokens fetch the rules filed under them, and only those run their regular expressions.

Site rules (host, path) fit a host and its subdomains where the url's path starts with the
rule's; the longest host and path together win, and any site rule wins over patterns. Without a site
rule, a url that a pattern matches is blocked, all others are allowed. A url that is null or has no
`://` has an empty host and path, and still meets the patterns (null: none). Repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Pattern(NamedTuple):
    name: str
    regex: str
    tokens: tuple[str, ...]


class Site(NamedTuple):
    host: str
    path: str
    verdict: str


SITES = (Site("org", "/", "allow"), Site("example.org", "/es/", "block"), Site("example.org", "/en/1", "block"), Site("com", "/fr/", "allow"), Site("com", "/de/", "block"))
#: Matched against the lower-cased url.
PATTERNS = (
    Pattern("ad tracker", r"://([^/?#]*[.-])?ads-track[.-]", ("ads", "track")),
    Pattern("ad server", r"://([^/?#]*\.)?ads\.[a-z0-9-]+\.", ("ads",)),
    Pattern("spam farm", r"://([^/?#]*[.-])?spam-farm[.-]", ("spam", "farm")),
    Pattern("casino", r"://([^/?#]*[.-])?casino(-[a-z]+)?[.-]", ("casino",)),
    Pattern("bets", r"://([^/?#]*[.-])?free-bets?[.-]", ("free",)),
    Pattern("adult", r"://([^/?#]*[.-])?adult-x[.-]", ("adult",)),
    Pattern("adult tubes", r"[./_-]porn(-tube)?[./_-]", ("porn",)),
    Pattern("pills", r"://([^/?#]*[.-])?cheap-pills[.-]", ("cheap", "pills")),
    Pattern("warez", r"[./_-]warez[./_-]", ("warez",)),
    Pattern("phishing", r"[./_-]verify-your-account[./_-]", ("verify", "your", "account")),
    Pattern("link farm", r"://([^/?#]*[.-])?link-farm[.-]", ("link", "farm")),
    Pattern("session page", r"[?&;]phpsessid=[0-9a-f]+", ("phpsessid",)),
)
_TOKEN = re.compile(r"[a-z0-9]+")
_A_TO_Z = {c: c + 32 for c in range(65, 91)}
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
OUT = "host string, path string, rule string, verdict string, pattern string, n_candidates int"


def token_counts(pages: DataFrame, patterns: tuple[Pattern, ...]) -> dict[str, int]:
    """In how many urls each token of the rules occurs; at most one row for each such token reaches the driver."""
    known = sorted({t for p in patterns for t in p.tokens})
    if not known:
        return {}
    words = F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+"))
    counted = pages.select(F.explode(F.array_intersect(words, F.array(*map(F.lit, known)))).alias("token")).groupBy("token").count()
    return {r.token: r["count"] for r in counted.collect()}


def index(patterns: tuple[Pattern, ...], counts: dict[str, int]) -> dict[str, list[Pattern]]:
    """Rules by their rarest token (of equally rare ones the longest, then the first by name)."""
    out: dict[str, list[Pattern]] = {}
    for p in patterns:
        out.setdefault(min(p.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(p)
    return out


def site_rule(host: str, path: str, sites: dict[str, list[Site]]) -> Site | None:
    labels, best = host.split("."), None
    for k in range(len(labels)):
        for s in sites.get(".".join(labels[k:]), ()):
            if path.startswith(s.path) and (best is None or len(s.host) + len(s.path) > len(best.host) + len(best.path)):
                best = s
    return best


def _judged(batches: Iterator[pa.RecordBatch], filed: dict[str, list[Pattern]], sites: dict[str, list[Site]]) -> Iterator[pa.RecordBatch]:
    compiled = {p: re.compile(p.regex, re.DOTALL) for rules in filed.values() for p in rules}
    for batch in batches:
        rows = []
        for url in batch.column(1).to_pylist():
            found = _URL.search(url or "")
            host, path = (found[1].translate(_A_TO_Z), found[2]) if found else ("", "")
            site = site_rule(host, path, sites)
            low = (url or "").translate(_A_TO_Z)
            asked = [p for t in sorted(set(_TOKEN.findall(low))) for p in filed.get(t, ())]
            hits = sorted(p.name for p in asked if compiled[p].search(low))
            verdict = site.verdict if site else "block" if hits else "allow"
            rows.append((host, path, site and site.host + site.path, verdict, hits[0] if hits else None, len(asked)))
        kinds = [pa.string()] * 5 + [pa.int32()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["page_id", *(x.split()[0] for x in OUT.split(", "))])


def judge(pages: DataFrame, sites: tuple[Site, ...] = SITES, patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """(page_id, OUT): one row for each row of pages."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    filed = index(patterns, token_counts(plain, patterns))
    hosts: dict[str, list[Site]] = {}
    for s in sites:
        hosts.setdefault(s.host, []).append(s)
    return plain.mapInArrow(lambda batches: _judged(batches, filed, hosts), f"page_id long, {OUT}")
