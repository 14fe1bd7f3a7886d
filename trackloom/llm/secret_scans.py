"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query on trigrams is derived: an OR of alternatives, each an AND of trigrams
that a match cannot do without. The index, a stored table of postings, holds for every trigram that some query names the keys
of the documents that contain it. Intersecting the postings of an alternative's trigrams gives candidate (document, rule)
pairs; only those run the expression on the whole text. A rule whose expression has an alternative without trigrams is run on
every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import bounded, free, stored

#: More alternatives than this in an expression's expansion: that part counts as unknown text.
MOST_ALTERNATIVES = 64
#: Candidate keys are broadcast up to this many (8 bytes each, so some 64 MB as a hash table); beyond it they are shuffled.
BROADCAST_KEYS = 1_000_000


@dataclass(frozen=True)
class SecretRule:
    """``value``: the group whose length must reach ``least`` (0: the whole match). ``base``: counted in n_<kind> and base_sha256."""

    kind: str
    pattern: str
    value: int
    least: int
    base: bool = False


#: In the order in which kinds are listed when spans begin together.
RULES = [
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    SecretRule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    SecretRule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    SecretRule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----", 0, 0),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    SecretRule("google_api", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    SecretRule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 0),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    SecretRule("bearer", r"(?i:authorization:\x20*bearer)\x20+([A-Za-z0-9._~+/-]{16,}=*)", 1, 16),
]


def _expand(tree) -> list[list[str | None]]:
    """The expression's alternatives, each a list of literal pieces; None stands for unknown text, as do characters beyond ASCII, whose cases are many."""
    out: list[list[str | None]] = [[]]
    for op, arg in tree:
        if op is C.LITERAL:
            each = [[chr(arg) if arg < 128 else None]]
        elif op is C.IN and all(k is C.LITERAL and v < 128 for k, v in arg) and len(arg) <= 8:
            each = [[chr(v)] for _, v in arg]
        elif op is C.SUBPATTERN:
            each = _expand(arg[-1])
        elif op is C.BRANCH:
            each = [x for part in arg[1] for x in _expand(part)]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] == 1:
            each = ([[]] if arg[0] == 0 else []) + _expand(arg[2])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            once = _expand(arg[2])
            # What is repeated may be another alternative each time; of more than two, the first and the last are known.
            each = [[*x, *([] if arg[0] == arg[1] == 2 else [None]), *y] for x in once for y in once] if arg[0] > 1 else [[*x, None] for x in once]
        elif op is C.AT:
            each = [[]]
        else:
            each = [[None]]
        if len(out) * len(each) > MOST_ALTERNATIVES:
            each = [[None]]
        out = [[*x, *y] for x in out for y in each]
    return out


def trigram_query(pattern: str) -> list[list[str]]:
    """An OR of ANDs of lower-case trigrams that every match fulfils; [] if the expression has no such query.

    >>> trigram_query("ab[cd]e")
    [['abc', 'bce'], ['abd', 'bde']]
    """
    query: set[tuple[str, ...]] = set()
    for pieces in _expand(parser.parse(pattern)):
        runs = "".join("\0" if p is None else p for p in pieces).lower().split("\0")
        found = {r[k : k + 3] for r in runs for k in range(len(r) - 2)}
        if not found:
            return []
        query.add(tuple(sorted(found)))
    return [list(q) for q in sorted(query) if not any(set(o) < set(q) for o in query)]


def trigram_finder(wanted: list[str]) -> str:
    """An expression whose first group is, at every place of a text where one of the trigrams stands, that trigram, in either case. Alternatives are grouped by their first character."""
    either = lambda ch: f"[{ch}{ch.upper()}]" if ch != ch.upper() and len(ch.upper()) == 1 else re.escape(ch)
    firsts: dict[str, list[str]] = {}
    for t in sorted(wanted):
        firsts.setdefault(t[0], []).append(t[1:])
    return "(?=(" + "|".join(either(c) + "(?:" + "|".join("".join(map(either, r)) for r in rest) + ")" for c, rest in firsts.items()) + "))"


def postings(docs: DataFrame, queries: dict[str, list[list[str]]], text: str = "text", key: str = "__key") -> DataFrame:
    """The inverted index (trigram, key), of the trigrams that the queries name. A text is read once."""
    wanted = sorted({t for q in queries.values() for alternative in q for t in alternative})
    held = F.array_distinct(F.transform(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(trigram_finder(wanted)), F.lit(1)), F.lower))
    return docs.select(F.explode(held).alias("trigram"), key)


def candidates(index: DataFrame, queries: dict[str, list[list[str]]], key: str = "__key") -> DataFrame:
    """(key, __rules): the documents whose postings fulfil a rule's query.

    The postings of each alternative's trigrams are intersected: a key is in all of them if the bits that it has from them, one
    for each trigram, are all set. Of an alternative with more than 62 trigrams the first 62 are asked for. The queries, a few
    rows for each rule, are a constant of the caller.
    """
    terms = [(t, f"{rule} {n}", rule, 1 << k, (1 << min(len(q), 62)) - 1) for rule, qs in queries.items() for n, q in enumerate(qs) for k, t in enumerate(q[:62])]
    asked = index.sparkSession.createDataFrame(terms, "trigram string, alternative string, rule string, bit long, whole long")
    hit = index.join(F.broadcast(asked), "trigram").groupBy(key, "alternative", "rule", "whole").agg(F.bit_or("bit").alias("bits")).where("bits = whole")
    return hit.groupBy(key).agg(F.collect_set("rule").alias("__rules"))


def _spans(text: Column, rule: SecretRule, order: int) -> Column:
    """The rule's leftmost non-overlapping matches as structs (start, order, end, kind), in code points: what lies between the matches gives their places."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.char_length(g))
    values = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.value)), lambda v: F.char_length(v)) if rule.value else F.transform(hits, lambda h: F.char_length(h))
    rows = F.arrays_zip(gaps.alias("gap"), F.transform(hits, lambda h: F.char_length(h)).alias("size"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,o:int,end:int,kind:string>>").alias("found"))

    def step(acc: Column, row: Column) -> Column:
        begin = acc["at"] + row["gap"]
        end = begin + row["size"]
        one = F.struct(begin.alias("start"), F.lit(order).alias("o"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(row["value"] >= rule.least, F.concat(acc["found"], F.array(one))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(F.filter(rows, lambda r: r["size"].isNotNull()), start, step, lambda acc: acc["found"])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, rules: list[SecretRule] | None = None, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """The input's columns and ``out``: array of (start, o, end, kind) by start, then the rules' order.

    Null texts count as empty. One row per input row; repeated rows stay, and empty tables give none. A column of the name
    ``out`` is replaced; other columns may have any name.

    Texts move at most once, and only if there are more candidate documents than BROADCAST_KEYS: else their keys are sent to
    where the texts are. A key stands for a document's whole content, so equal keys can but propose the same rules.
    """
    rules = RULES if rules is None else rules
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    names = [c for c in docs.columns if c.lower() != out.lower()]
    key, found = free("__key", names), free("__rules", names)
    own = [F.col(f"`{c}`") for c in names]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    if indexed:
        keyed = docs.select(*own, F.xxhash64(F.col(f"`{text}`")).alias(key))
        index = stored(postings(keyed, indexed, text, key))
        hits = stored(candidates(index, indexed, key).withColumnRenamed("__rules", found))
        docs = keyed.join(bounded(hits, BROADCAST_KEYS), key, "left")
    else:
        docs = docs.withColumn(found, F.array().cast("array<string>"))
    nothing = F.array().cast("array<struct<start:int,o:int,end:int,kind:string>>")
    each = []
    for order, rule in enumerate(rules):
        fits = F.array_contains(found, rule.kind) if rule.kind in indexed else body.rlike(rule.pattern)
        each.append(F.when(fits, _spans(body, rule, order)).otherwise(nothing))
    return docs.select(*own, (F.array_sort(F.concat(*each)) if each else nothing).alias(out))


def redact(docs: DataFrame, text: str = "text", mark: str = "<{}>", spans: str = "secret_spans") -> DataFrame:
    """``text`` with every span of the column ``spans`` replaced by its kind's mark; spans that overlap are replaced as one, under the first one's kind."""
    found, body = F.col(f"`{spans}`"), F.col(f"`{text}`")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.array(F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.format_string(mark.replace("{}", "%s"), s["kind"]))
        inside = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], piece)).alias("out"))

    folded = F.aggregate(found, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(body, acc["at"] + 1, F.char_length(body))))
    return docs.withColumn(text, F.when(F.size(found) > 0, folded).otherwise(body))
