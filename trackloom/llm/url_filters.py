"""URL filters: pattern rules found through their rarest literal token.

Every rule is a regular expression over ``host + path`` of a URL, the host in lower case. From the parsed expression the literal
tokens (runs of letters and digits that every match contains whole) are derived; the rule is filed under the one that fewest URLs
of the corpus contain. A URL's own tokens fetch its candidate rules from that index, and only those run their expressions. Rules
without a literal token are tried on every URL.

Rules are an argument that the caller holds in memory, or lines of a block list table, of which there are some hundred thousand
at most; the index goes to the tasks once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import ASCII_LOWER, LOWER, UPPER, free

TOKEN = r"[a-z0-9]+"
#: Ways through an expression that are told apart; the alternatives of one with more are unknown text.
MOST_WAYS = 64
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """``tokens``: literal tokens that any match contains, in lower case; ``ways``: where there are none, those of each alternative. ``weight``: the heaviest fitting rule decides."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int
    reported: bool = True
    ways: tuple[tuple[str, ...], ...] = ()


def _sequences(tree) -> list[list[str | None]]:
    """The ways through an expression, each as characters, None for unknown text and "" for a place where a token may end: only what every match that goes this way has. Alternatives beyond MOST_WAYS are unknown text."""
    ways: list[list[str | None]] = [[]]

    def add(tails: list[list[str | None]]) -> None:
        nonlocal ways
        ways = [w + tail for w in ways for tail in tails] if len(ways) * len(tails) <= MOST_WAYS else [[*w, None] for w in ways]

    for op, arg in tree:
        if op is C.LITERAL and arg < 128:
            add([[chr(arg)]])
        elif op is C.SUBPATTERN:
            add(_sequences(arg[-1]))
        elif op is C.BRANCH:
            add([way for branch in arg[1] for way in _sequences(branch)])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            once = _sequences(arg[2])
            if arg[0] == 0 or len(once) > 1:
                add([[None]])
            elif arg[0] == arg[1] <= 3:
                add([once[0] * arg[0]])
            else:
                add([[*once[0], None, *once[0]] if arg[0] > 1 else [None, *once[0], None]])
        elif op is C.AT and arg in (C.AT_BEGINNING, C.AT_BEGINNING_STRING, C.AT_END, C.AT_END_STRING, C.AT_BOUNDARY):
            add([[""]])
        elif op is C.IN and all(k is C.LITERAL and not chr(v).isalnum() for k, v in arg):
            add([["/"]])
        else:
            add([[None]])
    return ways


def alternatives_of(pattern: str) -> tuple[tuple[str, ...], ...]:
    """For each way through an expression the tokens, in lower case, that every text has which it matches that way: runs of letters and digits that nothing can lengthen. A rule is found by one token of each.

    >>> alternatives_of(r"/wp-admin/[a-z]+\\.php")
    (('admin', 'wp'),)
    >>> alternatives_of(r"\\.(?:exe|apk)\\Z")
    (('apk',), ('exe',))
    """
    out = set()
    for way in _sequences(parser.parse(pattern)):
        found, run, whole = set(), "", False
        for ch in [*way, None]:
            if ch is not None and ch != "" and ch.isalnum():
                run += ch.lower()
                continue
            if run and whole and ch is not None:
                found.add(run)
            run, whole = "", ch is not None
        out.add(tuple(sorted(found)))
    # A way whose tokens another one has all of finds that one too.
    return tuple(sorted(w for w in out if not any(set(o) < set(w) for o in out)))


def tokens_of(pattern: str) -> tuple[str, ...]:
    """The tokens that every text has which the expression matches, whichever way.

    >>> tokens_of(r"/wp-admin/[a-z]+\\.php")
    ('admin', 'wp')
    """
    return tuple(sorted(set.intersection(*map(set, alternatives_of(pattern)))))


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host with its subdomains and a path prefix, which begins with a slash."""
    pattern = rf"\A(?:[^/]*\.)?{re.escape(host + path)}"
    return Rule(host + path, verdict, pattern, tokens_of(pattern.replace("(?:[^/]*\\.)?", "")), 1000 + len(host) + len(path))


def label_rule(verdict: str, label: str) -> Rule:
    """A rule for any host that has this label, as in ``||label.`` of block lists. It yields to host rules."""
    pattern = rf"\A(?:[^/]*\.)?{re.escape(label)}\."
    return Rule(f"||{label}.", verdict, pattern, tokens_of(pattern.replace("(?:[^/]*\\.)?", "")), len(label), False)


def domain_rule(verdict: str, host: str) -> Rule:
    """A rule for a host with its subdomains, as in ``||host^`` of block lists."""
    pattern = rf"\A(?:[^/]*\.)?{re.escape(host)}(?::\d+)?(?:/|\Z)"
    return Rule(f"||{host}^", verdict, pattern, tokens_of(rf"\A{re.escape(host)}\Z"), len(host), False)


def pattern_rule(verdict: str, name: str, pattern: str) -> Rule:
    """Any expression over host + path; its classes and its flag for either case know ASCII only."""
    tokens = tokens_of(pattern)
    return Rule(name, verdict, pattern, tokens, 1, False, () if tokens else alternatives_of(pattern))


def list_rule(line: str | None) -> Rule | None:
    """A line of a block list: ``||host^``, ``||label.``, ``@@`` before either for an exception, ``/expression/``, or a line of a hosts file (``0.0.0.0 host``). None for comments and what else there may be.

    >>> list_rule("||Ads.example^").name, list_rule("0.0.0.0 bad.example").name, list_rule("! comment")
    ('||ads.example^', '||bad.example^', None)
    """
    line = (line or "").strip()
    verdict = ALLOW if line.startswith("@@") else BLOCK
    line = line.removeprefix("@@")
    if m := re.fullmatch(r"\|\|([^/^*$|\s]+)\^", line):
        return domain_rule(verdict, m[1].translate(ASCII_LOWER))
    if m := re.fullmatch(r"\|\|([^/^*$|\s]+)\.", line):
        return label_rule(verdict, m[1].translate(ASCII_LOWER))
    if m := re.fullmatch(r"(?:0\.0\.0\.0|127\.0\.0\.1)\s+(\S+)(?:\s*#.*)?", line):
        return domain_rule(verdict, m[1].translate(ASCII_LOWER))
    if len(line) > 2 and line[0] == line[-1] == "/":
        return pattern_rule(verdict, line, line[1:-1])
    return None


def list_rules(lines: DataFrame, col: str = "line") -> list[Rule]:
    """The rules of a block list table, each once, in the order of their names. A list is small beside the URLs: it is an argument, like any rules."""
    found = {r.name: r for row in lines.select(F.col(f"`{col}`")).distinct().toLocalIterator() if (r := list_rule(row[0]))}
    return [found[k] for k in sorted(found)]


#: The site policy that reports its rule.
SITE_RULES = [
    host_rule(ALLOW, "com", "/"),
    host_rule(BLOCK, "example.com", "/en/"),
    host_rule(ALLOW, "www.example.com", "/en/"),
    host_rule(BLOCK, "net", "/es/"),
    host_rule(BLOCK, "net", "/fr/"),
]
#: What decides where no site rule fits; a URL that none of them fits is allowed, one without a host is blocked.
LIST_RULES = [
    label_rule(BLOCK, "spam-farm"),
    label_rule(BLOCK, "cheap-pills"),
    label_rule(BLOCK, "ads-track"),
    label_rule(BLOCK, "casino"),
    label_rule(BLOCK, "doubleclick"),
    pattern_rule(BLOCK, "/wp-admin/", r"/wp-admin/"),
    pattern_rule(BLOCK, "executables", r"(?i)\.(?:exe|apk|msi)\Z"),
]


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and where ``://`` is missing."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(ASCII_LOWER), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def token_counts(urls: DataFrame, col: str, rules: list[Rule]) -> dict[str, int]:
    """In how many URLs each token of the rules occurs: one aggregation over all URLs, at most one row per rule token."""
    wanted = sorted({t for r in rules for way in (r.tokens, *r.ways) for t in way})
    if not wanted:
        return {}
    seen = F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(F.col(f"`{col}`").cast("string"), F.lit("")), UPPER, LOWER), F.lit(TOKEN), F.lit(0)))
    asked = urls.sparkSession.createDataFrame([(t,) for t in wanted], "t string")
    rows = urls.select(F.explode(seen).alias("t")).join(F.broadcast(asked), "t").groupBy("t").count().collect()
    return {t: 0 for t in wanted} | {r["t"]: r["count"] for r in rows}


def build_index(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    """Token -> rules filed under it, and the rules that have no token. A rule without a token of its own is filed under one of each of its alternatives, if all have some."""
    index: dict[str, list[Rule]] = {}
    rest = []
    for r in rules:
        ways = r.ways or (r.tokens,)
        if all(ways):
            for rarest in {min(way, key=lambda t: (counts.get(t, 0), t)) for way in ways}:
                index.setdefault(rarest, []).append(r)
        else:
            rest.append(r)
    return index, rest


def filter_urls(urls: DataFrame, rules: list[Rule] | None = None, col: str = "url") -> DataFrame:
    """The input's columns and ``host``, ``path``, ``rule``, ``verdict``, ``matched_rule``; one row per input row.

    ``rule`` is the deciding rule if it is one that is reported, ``matched_rule`` the deciding rule of any kind. The heaviest
    fitting rule decides; equal weights fall to block, then to the smaller name. Columns of the input with one of these names
    are replaced. Null, empty and host-less URLs have empty parts and are blocked. Repeated rows stay. No shuffle but that of
    the token counts.
    """
    rules = SITE_RULES + LIST_RULES if rules is None else rules
    shared = urls.sparkSession.sparkContext.broadcast(build_index(rules, token_counts(urls, col, rules)))

    def judge(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index, rest = shared.value
        known: dict[str, re.Pattern] = {}
        token = re.compile(TOKEN)

        def fits(r: Rule, at: str) -> bool:
            if r.pattern not in known:
                known[r.pattern] = re.compile(r.pattern, re.ASCII)
            return known[r.pattern].search(at) is not None

        for batch in frames:
            out = []
            for url in batch:
                host, path = parts(url)
                if not host:
                    out.append((host, path, None, BLOCK, None))
                    continue
                at, best = host + path, None
                fetched = [r for t in set(token.findall(at.translate(ASCII_LOWER))) for r in index.get(t, ())]
                for r in (*fetched, *rest):
                    if (best is None or (r.weight, r.verdict, best.name) > (best.weight, best.verdict, r.name)) and fits(r, at):
                        best = r
                out.append((host, path, best.name if best and best.reported else None, best.verdict if best else ALLOW, best.name if best else None))
            yield pd.DataFrame(out, columns=["host", "path", "rule", "verdict", "matched_rule"])

    judged = F.pandas_udf(judge, "host string, path string, rule string, verdict string, matched_rule string")
    kept = [F.col(f"`{c}`") for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict", "matched_rule")]
    out = free("__j", urls.columns)
    return urls.select(*kept, judged(F.col(f"`{col}`").cast("string")).alias(out)).select(*kept, f"{out}.*")
