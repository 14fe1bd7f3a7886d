"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

One pass over a text: at each position the automaton gives, by its output links, all pieces that end there, and each of them
relaxes the best score of the position (Viterbi). A BPE model's segmentation is not the one with the best sum of scores, so for
it the same pass keeps, at each position, the last piece of the prefix's BPE segmentation too: of the pieces that end there, the
one that can follow the last piece of the prefix before it. Two pieces can follow each other if merging their characters by
the model's ranks gives these two again; a sequence is a BPE segmentation if and only if all its neighbours can follow each
other.

A BPE model's pieces, with their scores as they are in the file, are a unigram model too: its best segmentation over all
pieces, by the Viterbi pass, is given beside the model's own.

White space is escaped and a leading one added as the model says. No segment crosses a place where no piece has the one character
behind the other: before a white space, a line's end or a mark, if the vocabulary is such. The pass then runs from place to
place, and what comes again is remembered.
"""

from __future__ import annotations

import gc
import re
import string
import threading
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: The score of a place where no piece has ended yet.
NONE = float("-inf")
#: Tokens, and pairs of pieces, remembered in a task.
MEMORY = 150_000
#: Seconds for which a task process keeps an encoder for its next task.
IDLE = 5.0


def _fields(raw: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, kind, raw[at : at + n]
            at += n


class _Memory(dict):
    """token -> its ids. When there are too many, those of late are kept as the older half, from which a token comes back when it is met again."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, token: str) -> tuple:
        out = self.old.get(token) or self.make(token)
        if len(token) <= 64:
            self[token] = out
        return out

    def age(self) -> None:
        if len(self) > MEMORY:
            self.old = dict(self)
            self.clear()


@dataclass
class Vocabulary:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    dummy_prefix: bool = True
    squeeze: bool = True
    identity: bool = True

    @classmethod
    def parse(cls, raw: bytes) -> Vocabulary:
        out = cls()
        for number, _, value in _fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, _, v in _fields(value):
                    if n == 1:
                        piece = v.decode("utf-8")
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        kind = v
                out.pieces.append((piece, score, kind))
            elif number == 2:
                for n, _, v in _fields(value):
                    if n == 3:
                        out.kind = v
                    elif n == 35:
                        out.byte_fallback = bool(v)
            elif number == 3:
                for n, _, v in _fields(value):
                    if n == 2:
                        out.identity = not v
                    elif n == 3:
                        out.dummy_prefix = bool(v)
                    elif n == 4:
                        out.squeeze = bool(v)
        return out


class Encoder:
    """Texts to ids and back, for one vocabulary."""

    def __init__(self, v: Vocabulary):
        if not v.identity:
            raise ValueError("only models whose normalizer is the identity are known")
        self.v = v
        self.id = {p: k for k, (p, _, kind) in enumerate(v.pieces) if kind in (NORMAL, USER)}
        self.unknown = next((k for k, p in enumerate(v.pieces) if p[2] == UNKNOWN), 0)
        self.byte = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(v.pieces) if kind == BYTE}
        # What each id stands for, in UTF-8, with spaces unescaped.
        raw = {k: bytes([b]) for b, k in self.byte.items()}
        shown = {NORMAL: lambda p: p.replace(SPACE, " ").encode(), USER: lambda p: p.replace(SPACE, " ").encode(), UNKNOWN: lambda p: " ⁇ ".encode()}
        self.bytes = [raw.get(k, b"") if kind == BYTE else shown.get(kind, lambda p: b"")(p) for k, (p, _, kind) in enumerate(v.pieces)]
        self.score = [s for _, s, _ in v.pieces]
        self.size = [len(p) for p, _, _ in v.pieces]
        self.lowest = min((v.pieces[k][1] for k in self.id.values()), default=0.0) - 10.0
        self.tokens = self._tokens()
        self.words = _Memory(self._packed)
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p, k in self.id.items():  # with each piece, whether a BPE model's merges can arrive at it
            self.automaton.add_word(p, (k, len(p), self.score[k], v.kind == BPE and self._merge(p) == [p]))
        if len(self.automaton):
            self.automaton.make_automaton()

    def _merge(self, text: str, wall: int = 0) -> list[str] | None:
        """BPE of a short text: the best-scored neighbours are merged first, the leftmost of equals. None as soon as a merge would go over ``wall``, a place in the text."""
        parts, known, score = list(text), self.id.get, self.score
        place = list(range(1, len(parts)))  # where each part but the last one ends
        rank = lambda a, b: NONE if (k := known(a + b)) is None else score[k]
        ranks = [rank(a, b) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (top := max(ranks)) != NONE:
            k = ranks.index(top)
            if place[k] == wall:
                return None
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k], place[k]
            if k:
                ranks[k - 1] = rank(parts[k - 1], parts[k])
            if k < len(ranks):
                ranks[k] = rank(parts[k], parts[k + 1])
        return parts

    def _follows(self, a: int, b: int) -> bool:
        """Whether piece b can come after piece a: merging their characters gives the two again, which it does if no merge goes from one to the other."""
        key = a * len(self.score) + b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > 3 * MEMORY:
                self.pairs.clear()
            x, y = self.v.pieces[a][0], self.v.pieces[b][0]
            ok = self.pairs[key] = self._merge(x + y, len(x)) is not None
        return ok

    def _tokens(self) -> re.Pattern | None:
        """Cuts a text, its white space not yet escaped, where no segment can cross: before a run of white space; around a line's end, if no piece has one; before a run of ASCII marks, unless it is behind a character that some piece joins to a mark. None if pieces hold white space behind other characters."""
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            return None
        end = "" if any("\n" in p for p in self.id) else "\n"
        line = f"{end}|" if end else ""
        marks = set(string.punctuation)
        joined = {a for p in self.id for a, b in zip(p, p[1:], strict=False) if b in marks and a not in marks and a != SPACE}
        m, j = (re.escape("".join(sorted(c))) for c in (marks, joined))
        behind = f"|(?<=[{j}])[{m}]+" if joined else ""
        return re.compile(f"{line} *[{m}]*(?:[^ {end}{m}]++{behind})+| *[{m}]+| +")

    def _packed(self, token: str) -> tuple[bytes, bytes, bool]:
        """``_segments`` with the ids as 32-bit numbers in a row, which texts are joined of."""
        ids, best, same = self._segments(token)
        return array("i", ids).tobytes(), array("i", best).tobytes(), same

    def _segments(self, token: str) -> tuple[tuple[int, ...], tuple[int, ...], bool]:
        """A token's ids by the model's own kind, and by Viterbi, in one pass of the automaton, and whether both stand for its bytes. A character without piece stands alone."""
        text = token.replace(" ", SPACE)
        n = len(text)
        best, piece = [0.0] + [NONE] * n, [-1] * (n + 1)
        own, bpe, known, lowest, count = [-1] * (n + 1), self.v.kind == BPE, self.pairs.get, self.lowest, len(self.score)
        for end, (k, length, score, reached) in self.automaton.iter(text) if len(self.automaton) else ():
            end += 1
            start = end - length
            # Viterbi: each piece that ends here relaxes the place's best score.
            before = best[start]
            if before == NONE:  # no piece ends there: the characters since the last one stand alone
                at = start
                while best[at] == NONE:
                    at -= 1
                for i in range(at, start):
                    best[i + 1] = best[i] + lowest
                before = best[start]
            score += before
            if score > best[end]:
                best[end], piece[end] = score, k
            # BPE: the piece that can follow the prefix's last one.
            if reached and own[end] < 0:
                last = own[start]
                if last < 0 or (ok := known(last * count + k)) or (ok is None and self._follows(last, k)):
                    own[end] = k
        found, whole = self._back(text, piece)
        if not bpe:
            return found, found, whole and SPACE not in token
        model, also = self._back(text, own)
        return model, found, whole and also and SPACE not in token

    def _back(self, text: str, piece: list[int]) -> tuple[tuple[int, ...], bool]:
        """The ids of the segments that end at the text's end, from each place's last piece, -1 where a character has none; and whether they stand for the text: an unknown character's don't, nor do the bytes of half a surrogate pair."""
        out, at, whole, size = [], len(text), True, self.size
        while at:
            k = piece[at]
            if k < 0:
                ch = text[at - 1]
                out += self._unknown(ch)[::-1]
                whole = whole and self.v.byte_fallback and bool(self.byte) and not "\ud800" <= ch <= "\udfff"
                at -= 1
            else:
                out.append(k)
                at -= size[k]
        out.reverse()
        return tuple(out), whole

    def _unknown(self, ch: str) -> list[int]:
        return [self.byte[b] for b in ch.encode("utf-8", "surrogatepass")] if self.v.byte_fallback and self.byte else [self.unknown]

    def encode_both(self, text: str | None) -> tuple[list[int], list[int], bool]:
        """``packed_both`` with the ids as lists."""
        ids, best, same = self.packed_both(text)
        return array("i", ids).tolist(), array("i", best).tolist(), same

    def packed_both(self, text: str | None) -> tuple[bytes, bytes, bool]:
        """The ids, as 32-bit numbers in a row, of the model's own segmentation and of the best one by Viterbi, which are the same for a unigram model, and whether decoding either gives the text.

        Each token's bytes are compared once and remembered; a text is only decoded if one of its tokens doesn't stand for them.
        """
        whole = text = text or ""
        if self.v.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return b"", b"", not whole
        kept = text == whole
        if self.v.dummy_prefix:
            text = " " + text
        # What is taken for white space stands for it in the pieces, too.
        parts = [text] if self.tokens is None else self.tokens.findall(text)
        found = list(map(self.words.__getitem__, parts))
        self.words.age()
        ids, best = b"".join(map(itemgetter(0), found)), b"".join(map(itemgetter(1), found))
        same = kept and self.v.dummy_prefix and all(map(itemgetter(2), found))
        return ids, best, same or (self.decode(array("i", ids)) == whole and self.decode(array("i", best)) == whole)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_both(text)[0]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.v.dummy_prefix and text.startswith(" ") else text


def load(path: str) -> Vocabulary:
    """The vocabulary of a model file on the driver's disk."""
    with open(path, "rb") as f:
        return Vocabulary.parse(f.read())


_ENCODERS: dict[str, Encoder] = {}
_TIMERS: list[threading.Timer] = []


def _drop() -> None:
    _ENCODERS.clear()
    gc.collect()  # an encoder and its memory refer to each other


@contextmanager
def _encoder(shared: Broadcast) -> Iterator[Encoder]:
    """One encoder per task process, that of the vocabulary used last: a broadcast's value is one object in a process.

    Spark's worker processes live on and run the tasks of other stages, so an encoder that no task has used for ``IDLE`` seconds goes,
    with the tokens that it remembers.
    """
    while _TIMERS:
        _TIMERS.pop().cancel()
    own = _ENCODERS.get("last")
    if own is None or own.v is not shared.value:
        own = _ENCODERS["last"] = Encoder(shared.value)
    try:
        yield own
    finally:
        timer = threading.Timer(IDLE, _drop)
        timer.daemon = True
        _TIMERS.append(timer)
        timer.start()


def with_ids(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """The input's columns and ``out``: the ids of the text. Null and empty texts have no ids. One row per input row; a column named ``out`` is replaced. The vocabulary, some tens of thousands of pieces, goes to the tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("array<int>")
    def encode(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with _encoder(shared) as own:
            for f in frames:
                yield pd.Series([np.asarray(own.encode(t), np.int32) for t in f], dtype=object)

    return docs.drop(out).withColumn(out, encode(F.col(f"`{text}`")))


def with_text(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The input's columns and ``out``: the text of the ids; empty for null ids."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("string")
    def decode(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with _encoder(shared) as own:
            for f in frames:
                yield pd.Series(["" if x is None else own.decode(np.asarray(x).tolist()) for x in f], dtype=object)

    return docs.drop(out).withColumn(out, decode(F.col(f"`{ids}`")))


def round_trips(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if not given) and ids, n_ids, viterbi_ids, round_trip.

    ids are those of the model's own kind, viterbi_ids those of the segmentation with the best sum of scores; for a unigram
    model they are the same. round_trip: whether decoding either gives the text, a null text being empty. One row per input row;
    input columns of these names are replaced, all others stay, dots in their names too. A text of any length is encoded whole.
    Both ways run in one task, so that the text goes to Python once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    new = ["ids", "n_ids", "viterbi_ids", "round_trip"]
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    plain = [f"c{k}" for k in range(len(names))]  # mapInArrow takes a dot in a name for a field's
    schema = StructType([StructField(p, docs.schema[c].dataType) for p, c in zip(plain, names, strict=True)]).add("ids", ArrayType(IntegerType())).add("n_ids", LongType()).add("viterbi_ids", ArrayType(IntegerType())).add("round_trip", BooleanType())

    def lists(flat: list[bytes], ends: list[int]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(flat), np.int32), pa.int32()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _encoder(shared) as own:
            for batch in batches:
                ids, best, ends, best_ends, same = [], [], [0], [0], []
                for t in batch.column(batch.num_columns - 1).to_pylist():
                    x, y, ok = own.packed_both(t)
                    ids.append(x)
                    best.append(y)
                    ends.append(ends[-1] + len(x) // 4)
                    best_ends.append(best_ends[-1] + len(y) // 4)
                    same.append(ok)
                counts = pa.array(np.diff(ends), pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists(ids, ends), counts, lists(best, best_ends), pa.array(same, pa.bool_())], [*plain, *new])

    own = docs.select(*[F.col(f"`{c}`").alias(p) for p, c in zip(plain, names, strict=True)], F.col(f"`{text}`").cast("string").alias("text"))
    return own.mapInArrow(work, schema).select(*[F.col(p).alias(c) for p, c in zip(plain, names, strict=True)], *new)
