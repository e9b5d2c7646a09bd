"""URL filters: path rules for hosts, and pattern rules found by their rarest literal token.

Pattern rules are wildcard patterns (``*`` any run, ``^`` a separator or the
end, ``||`` at the start a host boundary). Each is indexed by one literal
token, the one that the fewest rules share. A URL is cut into tokens; only the
rules that its tokens name run their regular expression. Rules without any
literal token are few and run always.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no host rule, and the patterns see an empty or the whole string. Rules are
a parameter of bounded size and travel with the task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names

TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
HOST_RULES = (
    HostRule("com", "/en/", "block"),
    HostRule("example.com", "/en/7", "allow"),
    HostRule("net", "/de/", "allow"),
    HostRule("example.net", "/de/8", "block"),
    HostRule("org", "/es/", "block"),
)

#: Pattern rules of the production query, as (pattern, verdict). Among those that match, the longest pattern wins.
PATTERNS = (
    ("/ads/*", "block"),
    ("/banner^", "block"),
    ("/tracker/*", "block"),
    ("/click?*redirect=", "block"),
    ("utm_source=*&utm_medium=", "block"),
    ("||casino.*^", "block"),
    ("||adult.*^", "block"),
    ("/login^", "block"),
    ("/search?q=", "block"),
    ("/docs/*/ads/*", "allow"),
    ("||archive.example^", "allow"),
)


def to_regex(pattern: str) -> str:
    head, rest = ("", pattern)
    if pattern.startswith("||"):
        head, rest = r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?", pattern[2:]
    parts = {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}
    return head + "".join(parts.get(c) or re.escape(c) for c in rest)


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that every URL the pattern matches holds as whole tokens: their neighbours in the pattern are no wildcard and no edge."""
    out = []
    body = pattern[2:] if pattern.startswith("||") else pattern
    for m in TOKEN.finditer(body):
        left = m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and pattern.startswith("||")
        right = m.end() < len(body) and body[m.end()] != "*"
        if left and right:
            out.append(m[0])
    return out


class PatternIndex:
    """Rules by their rarest literal token."""

    def __init__(self, patterns=PATTERNS):
        shared = Counter(t for p, _ in patterns for t in set(literal_tokens(p)))
        self.by_token: dict[str, list] = {}
        self.always: list = []
        for p, verdict in patterns:
            rule = (len(p), p, verdict, re.compile(to_regex(p)))
            tokens = literal_tokens(p)
            if tokens:
                self.by_token.setdefault(min(tokens, key=lambda t: (shared[t], -len(t), t)), []).append(rule)
            else:
                self.always.append(rule)

    def match(self, url: str) -> tuple[str | None, str | None, int]:
        """Pattern and verdict of the longest match (ties: first in order of text), and how many expressions ran."""
        low = url.lower()
        found = [r for t in set(TOKEN.findall(low)) for r in self.by_token.get(t, ())] + self.always
        hits = [r for r in found if r[3].search(low)]
        best = min(hits, key=lambda r: (-r[0], r[1]), default=None)
        return (best[1], best[2], len(found)) if best else (None, None, len(found))


def parts(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def host_rule(host: str, path: str, by_host: dict[str, list[HostRule]]) -> HostRule | None:
    """The longest rule for the host or a parent of it whose path begins the URL's path."""
    if not host:
        return None
    labels = host.split(".")
    fits = [r for i in range(len(labels)) for r in by_host.get(".".join(labels[i:]), ()) if path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.name), r.name), default=None)


def judge(df: DataFrame, url: str = "url", host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """Add host, path, rule, verdict, pattern and n_tried (expressions that ran). The verdict is the host rule's; without one the pattern's; without either allow.

    A null URL counts as empty. Ties of length go to the later host rule and the
    earlier pattern in order of text. Repeated rows stay, an empty table gives
    none. Columns of ``df`` stay; an added one whose name is taken gets an underscore.
    """
    names = df.columns
    new = free_names(("host", "path", "rule", "verdict", "pattern", "n_tried"), names)
    lit = [F.lit(None).cast("string").alias(n) for n in new[:5]] + [F.lit(None).cast("int").alias(new[5])]
    schema = df.select(*[F.col(f"`{n}`") for n in names], *lit).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, by_host = PatternIndex(patterns), {}
        for r in host_rules:
            by_host.setdefault(r.host, []).append(r)
        for b in batches:
            rows = []
            for u in b.column(url).to_pylist():
                host, path = parts(u)
                rule = host_rule(host, path, by_host)
                pattern, verdict, tried = index.match(u or "")
                rows.append((host, path, rule.name if rule else None, rule.verdict if rule else verdict or "allow", pattern, tried))
            cols = [pa.array([r[i] for r in rows], pa.string()) for i in range(5)] + [pa.array([r[5] for r in rows], pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + cols, names=[*names, *new])

    return df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


def page_verdicts(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "pattern", "n_tried")


def sql_of(patterns=PATTERNS) -> str:
    """The same verdicts in DuckDB SQL over ``pages``."""
    order = sorted(patterns, key=lambda p: (-len(p[0]), p[0]))
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    hit = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(url, '')), {quote(to_regex(p))}) THEN {quote(p)}" for p, _ in order) + " END"
    said = "CASE pattern " + " ".join(f"WHEN {quote(p)} THEN {quote(v)}" for p, v in order) + " ELSE 'allow' END"
    fits = sorted(HOST_RULES, key=lambda r: (-len(r.name), r.name))
    fit = lambda r: f"(host = {quote(r.host)} OR ends_with(host, {quote('.' + r.host)})) AND starts_with(path, {quote(r.path)})"
    rule = "CASE " + " ".join(f"WHEN {fit(r)} THEN {quote(r.name)}" for r in fits) + " END"
    ruled = "CASE rule " + " ".join(f"WHEN {quote(r.name)} THEN {quote(r.verdict)}" for r in fits) + " END"
    tried = " + ".join(
        f"(CASE WHEN regexp_matches(lower(coalesce(url, '')), {quote('(^|[^a-z0-9])' + t + '([^a-z0-9]|$)')}) THEN {len(rules)} ELSE 0 END)"
        for t, rules in sorted(PatternIndex(patterns).by_token.items())
    )
    return f"""
      WITH cut AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
      named AS (SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM cut),
      apart AS (SELECT page_id, url, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM named),
      ruled AS (SELECT *, {rule} AS rule, {hit} AS pattern, {tried} AS n FROM apart)
      SELECT page_id, host, path, rule, coalesce({ruled}, {said}) AS verdict, pattern, CAST(n + {len(PatternIndex(patterns).always)} AS INTEGER) AS n_tried FROM ruled"""
