"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are word sequences (lower case, letters and digits only). An item leaks into a document if some window of the document
is within ``rate`` of the item's length in word edits. Candidate windows are found by the embedding of Chakraborty, Goldenberg
and Koucky (2016): a random walk reads a sequence and writes the word it stands on at each of its steps, moving on or staying
as a random bit of (step, word) says. Sequences a few edits apart fall into step again, so that their walks agree in most
places: edit distance becomes Hamming distance. Each of several tables samples a few places of a walk; a window whose sampled
words equal an item's is a candidate, and is verified by the exact edit distance. Walks are repeated with fresh bits until the
target recall is reached.

Walks that a dropped or added clause has set apart by many words need far more steps to meet again than an item has. Each item is
therefore walked from up to 16 anchors along it, so that some walk begins behind the clause, and ends before the next; an item's
anchor that meets a word of the document stands for all windows that begin its distance before that word, give or take d words.

A window within d edits of an item of m words shares m - 2 - 3 d of its three-word sequences with it, as an edit spoils three at
most. Windows are walked only where that many sequences are known from the benchmark, and verified only where that many are the
item's own, which loses none of the windows sought.

The items are taken in blocks of bounded size, each block being sent to all tasks; every document is compared with every block.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, StructType

WORDS = re.compile(r"[^\W_]+")
#: Words of a block's items, at most, so that a block takes some tens of MB in a task; an item with more is a block of its own.
BLOCK_WORDS = 500_000
#: Items of a block, at most: each has up to 16 anchors' keys in all tables, which take some 16 KB.
BLOCK_ITEMS = 4_000
#: Words of a sequence in the count that a window has to reach before it is walked.
GRAM = 3
#: Cells of the arrays made at a time, which bounds a task's memory whatever a text's length.
CELLS = 2_000_000


@dataclass(frozen=True)
class Settings:
    """rate: word edits allowed for each word of the item; least: items with fewer words have to occur unchanged.

    tables, places: of each walk. A pair at the allowed distance, its edits scattered, is found in a table from one anchor with
    probability agree ** places, where agree is the share of places in which the walks agree; with agree = 0.45, 3 places and
    8 x 8 tables miss it with probability (1 - 0.09) ** 64 = 0.002. For edits in blocks the recall is measured:
    ``test_decontamination_of_dropped_clauses`` has the trials.
    """

    rate: float = 0.2
    least: int = 8
    walks: int = 8
    tables: int = 8
    places: int = 3
    seed: int = 7

    def edits(self, words: int) -> int:
        return int(self.rate * words) if words >= self.least else 0


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def edit_distances(x: np.ndarray, windows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end) for each row y of windows: the least word edits between x and any prefix of y, and that prefix's length; edits is most + 1 if it is more."""
    steps = np.arange(windows.shape[1] + 1)
    edits, ends = np.full(len(windows), most + 1), np.zeros(len(windows), np.int64)
    alive = np.arange(len(windows))
    row = np.repeat(steps[None], len(windows), axis=0)
    for k, c in enumerate(x, 1):
        cost = np.empty_like(row)
        cost[:, 0] = k
        np.minimum(row[:, :-1] + (windows != c), row[:, 1:] + 1, out=cost[:, 1:])
        row = np.minimum.accumulate(cost - steps, axis=1) + steps  # insertions
        if k % 8 == 0:
            near = row.min(axis=1) <= most
            if not near.all():
                alive, row, windows = alive[near], row[near], windows[near]
                if not len(alive):
                    return edits, ends
    end = row.argmin(axis=1)
    last = row[np.arange(len(row)), end]
    good = last <= most
    edits[alive[good]], ends[alive[good]] = last[good], end[good]
    return edits, ends


class Index:
    """A block of items, ready to be looked up; goes to the tasks as it is."""

    def __init__(self, items: list[tuple[object, str]], s: Settings):
        self.s = s
        self.code: dict[str, int] = {}
        self.items: list[tuple[object, np.ndarray]] = []
        for i, t in items:
            w = words(t)
            if w:
                self.items.append((i, np.array([self.code.setdefault(x, len(self.code) + 1) for x in w], np.int64)))
        r = np.random.RandomState(s.seed)
        self.seeds = r.randint(1, 2**62, s.walks, dtype=np.int64).astype(np.uint64)
        # Places lie within the walk over the shortest part that all windows of a class have; classes double in length.
        self.classes: dict[int, list[int]] = {}
        for k, (_, x) in enumerate(self.items):
            self.classes.setdefault(int(math.log2(len(x))), []).append(k)
        self.sampled = {c: np.array([np.sort(r.randint(0, max(1, int(1.2 * 2**c)), (s.tables, s.places)), axis=1) for _ in range(s.walks)]) for c in self.classes}
        # Of each class the sorted keys of its items in all tables, and beside each key the item and the anchor.
        self.found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for c, own in self.classes.items():
            found, which, anchor = [], [], []
            for k in own:
                x = self.items[k][1]
                # Items that have to occur unchanged are found from their first word.
                anchors = np.arange(0, len(x) if s.edits(len(x)) else 1, max(1, 2**c // 8))
                keys, inside = self.keys(x, anchors, c)
                inside[:, 0] = True
                found.append(keys[inside])
                which.append(np.full(len(found[-1]), k))
                anchor.append(np.broadcast_to(anchors, keys.shape)[inside])
            found, which, anchor = map(np.concatenate, (found, which, anchor))
            order = np.argsort(found, kind="stable")
            self.found[c] = found[order], which[order], anchor[order]
        self.length = np.array([len(x) for _, x in self.items], np.int64)
        self.most = np.array([s.edits(n) for n in self.length.tolist()], np.int64)
        #: Sequences that a window shares with the item at least.
        self.need = self.length - GRAM + 1 - GRAM * self.most
        grams = [self.grams(x) if len(x) >= GRAM else np.empty(0, np.uint64) for _, x in self.items]
        self.known = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.uint64)
        # Of each item the numbers of its sequences, from 1 on.
        self.own = [np.searchsorted(self.known, g) + 1 for g in grams]
        # The upper bits of the known sequences: most others are told apart by one look-up.
        self.shift = np.uint64(64 - max(16, int(np.log2(len(self.known) + 1)) + 5))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)
        self.maybe[(self.known >> self.shift).astype(np.int64)] = True
        self.needs = {c: sorted({(len(self.items[k][1]), self.s.edits(len(self.items[k][1]))) for k in own}) for c, own in self.classes.items()}
        self.least = min((max(0, m - GRAM + 1 - GRAM * d) for each in self.needs.values() for m, d in each), default=0)

    def grams(self, seq: np.ndarray) -> np.ndarray:
        n = len(seq) - GRAM + 1
        out = np.zeros(n, np.uint64)
        for k in range(GRAM):
            out = (out ^ seq[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return out

    def numbers(self, grams: np.ndarray) -> np.ndarray:
        """The sequences' numbers among the known ones, from 1 on; 0 for others."""
        out = np.zeros(len(grams), np.int64)
        at = np.flatnonzero(self.maybe[(grams >> self.shift).astype(np.int64)])
        if len(at):
            place = np.minimum(np.searchsorted(self.known, grams[at]), len(self.known) - 1)
            out[at] = np.where(self.known[place] == grams[at], place + 1, 0)
        return out

    def keys(self, seq: np.ndarray, starts: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys of the walks from the given starts, and whether all their sampled words are known ones: arrays (walk and table, start)."""
        places = self.sampled[c]
        walks, tables, _ = places.shape
        last = int(places.max())
        padded = np.concatenate([seq, np.zeros(last + 2, np.int64)])
        turns = self.seeds[:, None] + np.arange(last + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)
        at = np.repeat(starts[None], walks, axis=0)
        path = np.empty((last + 1, walks, len(starts)), np.uint64)
        for step in range(last + 1):
            word = path[step] = padded[at]
            word = word.astype(np.uint64)
            at += (((word * np.uint64(0xBF58476D1CE4E5B9) ^ turns[:, step, None]) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(63)).astype(np.int64)
        out = np.repeat(np.arange(walks * tables, dtype=np.uint64).reshape(walks, tables, 1), len(starts), axis=2)
        inside = np.ones(out.shape, bool)
        for k in range(places.shape[2]):
            taken = path[places[:, :, k], np.arange(walks)[:, None]]
            out = (out ^ taken) * np.uint64(0x9E3779B97F4A7C15) + places[:, :, k, None].astype(np.uint64)
            out ^= out >> np.uint64(29)
            inside &= taken > 0
        return out.reshape(walks * tables, len(starts)), inside.reshape(walks * tables, len(starts))

    def candidates(self, seq: np.ndarray, starts: np.ndarray, c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Items, and where they would begin in the document (maybe before it) if one of their anchors is the word at one of the starts; in parts."""
        found, which, anchor = self.found[c]
        step = max(1, CELLS // (self.s.walks * (int(self.sampled[c].max()) + 1)))
        for lo in range(0, len(starts), step):
            part = starts[lo : lo + step]
            keys, _ = self.keys(seq, part, c)
            first = np.minimum(np.searchsorted(found, keys), len(found) - 1)
            hit = found[first] == keys
            if not hit.any():
                continue
            first = first[hit]
            n = np.searchsorted(found, keys[hit], "right") - first
            entry = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item = which[entry]
            back = 2 ** (c + 1)  # more than any anchor
            start = np.repeat(np.broadcast_to(part, keys.shape)[hit], n) - anchor[entry] + back
            pairs = np.unique(item * np.int64(len(seq) + back) + start)
            yield pairs // (len(seq) + back), pairs % (len(seq) + back) - back

    def windows(self, item: np.ndarray, start: np.ndarray, fits: np.ndarray, total: np.ndarray) -> np.ndarray:
        """The distinct numbers item * len(fits) + place of the windows to verify: the places that fit, up to the item's edits beside a start, with enough known sequences."""
        last = len(total) - 1
        fitting = np.concatenate([[0], np.cumsum(fits)])
        # Up to d words were dropped or added before the anchor.
        most = self.most[item]
        near = fitting[np.minimum(np.maximum(start + most + 1, 0), last)] > fitting[np.minimum(np.maximum(start - most, 0), last)]
        item, start, most = item[near], start[near], most[near]
        out = [np.empty(0, np.int64)]
        beside = np.arange(-most.max(), most.max() + 1) if len(most) else np.empty(0, np.int64)
        for lo in range(0, len(item), step := max(1, CELLS // max(1, len(beside)))):
            place = start[lo : lo + step, None] + beside
            ok = (place >= 0) & (place < last) & (np.abs(beside) <= most[lo : lo + step, None])
            place, which = place[ok], np.broadcast_to(item[lo : lo + step, None], ok.shape)[ok]
            ok = fits[place]
            place, which = place[ok], which[ok]
            ok = total[np.minimum(place + self.length[which] + self.most[which], last)] - total[place] >= self.need[which]
            out.append(np.unique(which[ok] * np.int64(len(fits)) + place[ok]))
        return np.unique(np.concatenate(out))

    def search(self, text: str | None) -> list[tuple[object, int, int, int]]:
        """(item_id, start, end, edits) of the leaks in a text, in words, end exclusive, in the items' order: of each item, those that don't overlap, best first."""
        found = words(text)
        seq = np.fromiter(map(self.code.get, found, repeat(0)), np.int64, len(found))
        if not seq.any():
            return []
        number = np.zeros(len(seq), np.int64)
        if len(seq) >= GRAM and len(self.known):
            number[: len(seq) - GRAM + 1] = self.numbers(self.grams(seq))
        total = np.concatenate([[0], np.cumsum(number > 0)])
        if total[-1] < self.least:
            return []
        hits: dict[int, list[tuple[int, int, int]]] = {}
        of_item = np.zeros(max(len(self.code), len(self.known)) + 1, bool)

        def enough(each: np.ndarray, n: int, values: np.ndarray, own: np.ndarray, need: int) -> np.ndarray:
            """The places, which ascend, of those windows of n in which ``need`` values are among the item's own."""
            of_item[own] = True
            count = np.concatenate([[0], np.cumsum(of_item[values[each[0] : each[-1] + n]])])
            of_item[own] = False
            near = each - each[0]
            return each[count[np.minimum(near + n, len(count) - 1)] - count[near] >= need]

        for c in self.classes:
            # The window within d edits begins and ends with a word of the item, and has m + d words at most. First the class's
            # longest window is held against its least need, then, where that is met, each length against its own.
            needs = [(m + d, m - GRAM + 1 - GRAM * d) for m, d in self.needs[c]]
            longest, least = max(n for n, _ in needs), min(need for _, need in needs)
            ends = np.minimum(np.arange(len(seq)) + longest, len(seq))
            starts = np.flatnonzero((total[ends] - total[:-1] >= least) & (seq > 0))
            fit = np.zeros(len(starts), bool)
            for n, need in needs if len(starts) else ():
                if need <= total[-1]:
                    fit |= total[np.minimum(starts + n, len(seq))] - total[starts] >= need
            starts = starts[fit]
            if not len(starts):
                continue
            fits = np.zeros(len(seq) + 1, bool)
            fits[starts] = True
            # Walks begin on the words of the windows that are left, as anchors lie anywhere in them.
            opened = np.cumsum(np.bincount(starts, minlength=len(seq) + 1) - np.bincount(np.minimum(starts + longest, len(seq)), minlength=len(seq) + 1))
            walked = np.flatnonzero((opened[:-1] > 0) & (seq > 0))
            chosen = [self.windows(item, start, fits, total) for item, start in self.candidates(seq, walked, c)]
            chosen = np.unique(np.concatenate(chosen)) if chosen else np.empty(0, np.int64)
            of, at = chosen // len(fits), chosen % len(fits)
            cut = np.flatnonzero(np.diff(of)) + 1
            for k, each in zip(of[np.concatenate([[0], cut])].tolist(), np.split(at, cut), strict=True) if len(of) else ():
                item, most = self.items[k][1], int(self.most[k])
                n = len(item) + most
                # At most d edits leave all but d of the item's words in the window, and all but 3 d of its sequences.
                if self.need[k] > 0:
                    each = enough(each, n, number, self.own[k], int(self.need[k]))
                if len(each):
                    each = enough(each, n, seq, item, len(item) - most)
                if not len(each):
                    continue
                padded = np.concatenate([seq, np.zeros(n, np.int64)])
                for lo in range(0, len(each), step := max(1, CELLS // n)):
                    part = each[lo : lo + step]
                    edits, length = edit_distances(item, padded[part[:, None] + np.arange(n)], most)
                    for j in np.flatnonzero(edits <= most):
                        hits.setdefault(k, []).append((int(edits[j]), int(part[j]), int(part[j] + length[j])))
        out = []
        for k, each in sorted(hits.items()):
            taken: list[tuple[int, int]] = []
            for edits, start, end in sorted(each):
                if all(end <= a or start >= b for a, b in taken):
                    taken.append((start, end))
                    out.append((k, start, end, edits))
        return [(self.items[k][0], start, end, edits) for k, start, end, edits in sorted(out)]


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """The items in the order of their ids, null ids first, in blocks of bounded size, fetched one after another. Rows that are equal in id and text are one item."""
    block, size = [], 0
    items = benchmark.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).where("t is not null").distinct()
    for r in items.orderBy("i", "t").toLocalIterator():
        n = len(words(r["t"]))
        if block and (size + n > BLOCK_WORDS or len(block) == BLOCK_ITEMS):
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += n
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "leaks") -> DataFrame:
    """The input's columns and ``out``: array of (item_id, start, end, edits), in words of the document, by item_id (null first), then place.

    One row per input row, and repeated rows stay. Null, empty and word-less texts have none, as have all texts if the
    benchmark is empty; items without words are never found. Item ids are of any simple type and may be null or shared. A column
    of the name ``out`` is replaced. Nothing is shuffled.
    """
    s = settings or Settings()
    sc = docs.sparkSession.sparkContext
    kind = StructType().add("item_id", benchmark.schema[item_id].dataType).add("start", LongType()).add("end", LongType()).add("edits", LongType())
    found = []
    for block in blocks(benchmark, item_id, item_text):
        found.append(_lookup(sc.broadcast(Index(block, s)), ArrayType(kind))(F.col(f"`{text}`").cast("string")))
    # Blocks are in the order of the ids.
    every = F.concat(*found) if found else F.array().cast(ArrayType(kind))
    return docs.drop(out).withColumn(out, every)


def _lookup(index: Broadcast, kind: DataType) -> Callable:
    @F.pandas_udf(kind)
    def look(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for f in frames:
            yield pd.Series([[dict(zip(("item_id", "start", "end", "edits"), h, strict=True)) for h in index.value.search(t)] for t in f], dtype=object)

    return look
