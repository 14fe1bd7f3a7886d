"""Quality rules: base counts, and divergence from a language's usual distributions.

Each document gets two histograms: over classes of characters, and over the common words of its language with one class for
all other words. They are compared by the Jensen-Shannon distance with the references of the document's language, which are
the summed histograms of all documents of that language that the base rules pass. Documents that are too short for a stable
histogram are not judged by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import free, stored

SYMBOLS = "#*$%&|<>"
#: Frequent function words.
COMMON = {
    "en": "the of and to a in is that it for was on are as with be at by this from or have an not you but".split(),
    "fr": "le la les de des du et un une est que qui en au pour par sur dans ce il ne pas se plus à".split(),
    "de": "der die das und ist in zu den von mit nicht ein eine für auf im dem des als auch sich es an er wird".split(),
    "es": "el la los las de que y en un una es por con para se no al lo como más del su o".split(),
}
#: Classes of characters: lower case, upper case, digit, white space, sentence marks, other punctuation and symbols, letters without case.
CLASSES = 7
#: What is added to a document's columns, in place of columns of these names.
OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars_hist", "words_hist", "chars_distance", "words_distance", "kept")
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEMORY = 200_000


@dataclass(frozen=True)
class Settings:
    """Guards: the least characters and words for the histograms to be judged. Limits: the largest distances of a kept document."""

    least_chars: int = 200
    least_words: int = 50
    most_chars_distance: float = 0.22
    most_words_distance: float = 0.45


def _class_of(ch: str) -> int:
    if ch.islower():
        return 0
    if ch.isupper():
        return 1
    if ch.isdigit():
        return 2
    if ch.isspace():
        return 3
    if ch in ".,;:?'\"()-":
        return 4
    return 6 if ch.isalpha() else 5


_TABLE = np.array([_class_of(chr(k)) for k in range(0x3000)], np.uint8)


def char_classes(text: str) -> list[int]:
    at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(np.where(at < len(_TABLE), _TABLE[np.minimum(at, len(_TABLE) - 1)], 6), minlength=CLASSES).tolist()


def repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(ids) < 4:
        return 0
    n = np.int64(ids.max() + 1)
    if n < 2_000_000:
        window = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:
        pair = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)[1]
        window = pair * n + ids[2:]
    _, where, count = np.unique(window, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[where] > 1)
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[twice + k] = True
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int, dict[bytes, int]]:
    """The base counts and the words with their counts."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    counts = np.bincount(at, minlength=len(ids)).tolist() if len(words) else []
    lines, dup = set(), 0
    for line in raw.split(b"\n"):
        if line.split(None, 1):
            dup += line in lines
            lines.add(line)
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), dup, repeat_words(at), dict(zip(ids, counts, strict=True))


def word_classes(words: dict[bytes, int], lang: str | None) -> list[int]:
    """Counts of the language's common words, then of all others; of an unknown language only the latter. Case and marks around a word don't matter."""
    common = COMMON.get(lang or "", ())
    place = {w: k for k, w in enumerate(common)}
    out = [0] * (len(common) + 1)
    for w, n in words.items():
        out[place.get(w.decode("utf-8", "replace").lower().strip(".,;:!?\"'()"), -1)] += n
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """The square root of the Jensen-Shannon divergence in bits: 0 for equal shares, 1 for disjoint ones; 1 if either is empty."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        total = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, total / 2)))


def measured(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The input's columns without the text, the base counts, base_failed, and the histograms chars_hist and words_hist; input columns of these names, in any case, go."""
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), *OWN)]
    m = free("__m", kept)
    kind = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_hist array<long>, words_hist array<long>"

    def work(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, langs in frames:
            rows = []
            for t, la in zip(texts, langs, strict=True):
                t = t or ""
                *counts, words = base_counts(t)
                rows.append((*counts, char_classes(t), word_classes(words, la)))
            yield pd.DataFrame(rows, columns=[*BASE, "chars_hist", "words_hist"])

    work.__annotations__ = {"frames": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.pandas_udf(work, kind)(F.col(f"`{text}`"), F.col(f"`{lang}`")).alias(m)).select(*[F.col(f"`{c}`") for c in kept], f"{m}.*")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def references(measures: DataFrame, lang: str = "lang") -> DataFrame:
    """(lang, chars_ref, words_ref): the summed histograms of all documents that pass the base rules; one row per language."""
    each = lambda c, n: [F.sum(F.get(c, F.lit(k))).alias(f"{c}{k}") for k in range(n)]
    most = 1 + max(map(len, COMMON.values()))
    sums = measures.where(~F.col("base_failed")).groupBy(F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias("lang")).agg(*each("chars_hist", CLASSES), *each("words_hist", most))
    whole = lambda c, n: F.array_compact(F.array(*[f"{c}{k}" for k in range(n)]))
    return sums.select("lang", whole("chars_hist", CLASSES).alias("chars_ref"), whole("words_hist", most).alias("words_ref"))


def quality(docs: DataFrame, settings: Settings | None = None, text: str = "text", lang: str = "lang", scratch: list[str] | None = None) -> DataFrame:
    """The input's columns without the text, the base counts, base_failed, chars_distance, words_distance and kept.

    kept is false where base_failed is; else false where a document past the guards lies beyond a limit. Distances are null
    for documents below the guards and for languages without reference; words_distance also for those without common words.
    Null texts count as empty, null languages as one language of their own. A text of any length is counted whole. One row per
    input row; repeated rows stay. Columns named as the new ones, in any case, are replaced; all others stay, whatever their names.
    Measures are stored once, so each text is read once; the references join by language, of which there are few: the join
    goes by Spark's own measure of their size. ``scratch`` gets the path of the table that the result reads.
    """
    s = settings or Settings()
    m = stored(measured(docs, text, lang), scratch)
    joined_by, chars_ref, words_ref = (free(c, m.columns) for c in ("__lang", "chars_ref", "words_ref"))
    known = references(m, lang).toDF(joined_by, chars_ref, words_ref)

    def compare(frames: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for a, b in frames:
            yield pd.Series([None if q is None or p is None else js_distance(np.asarray(p, float), np.asarray(q, float)) for p, q in zip(a, b, strict=True)], dtype="float64")

    compare.__annotations__ = {"frames": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    distance = F.pandas_udf(compare, "double")
    joined = m.withColumn(joined_by, F.coalesce(F.col(f"`{lang}`"), F.lit(""))).join(known, joined_by, "left")
    chars = F.aggregate("chars_hist", F.lit(0).cast("long"), lambda x, y: x + y)
    guard = (F.col("n_words") >= s.least_words) & (chars >= s.least_chars)
    out = joined.withColumn("chars_distance", distance(F.when(guard, F.col("chars_hist")), F.col(chars_ref)))
    out = out.withColumn("words_distance", distance(F.when(guard & (F.size("words_hist") > 1), F.col("words_hist")), F.col(words_ref)))
    far = (F.coalesce("chars_distance", F.lit(0.0)) > s.most_chars_distance) | (F.coalesce("words_distance", F.lit(0.0)) > s.most_words_distance)
    return out.withColumn("kept", ~F.col("base_failed") & ~far).drop(joined_by, chars_ref, words_ref, "chars_hist", "words_hist")
