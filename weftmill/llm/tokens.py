"""Encoding with a public byte-level BPE by a streaming transducer of bounded lookahead.

The ids of a prefix of a piece end in one definite token: the longest-reaching one that is compatible with the token
before it, where two tokens are compatible if the merges, run over their joined bytes, give just these two. So the
encoding is found from left to right, one byte at a time, and every piece of every length takes this way. The lookahead
follows from the merge list: whatever comes next, the token that covers the next byte begins here or at one of the
positions from which the bytes read so far are a proper prefix of some token. A token through which the encodings of all
these prefixes run is stable and is emitted; only what lies behind the last stable token is kept, at most as many bytes
as the longest token has twice over.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType

#: Where the public tokenizers lie; a parameter of every operator here.
TOKENIZERS = os.environ.get("WEFTMILL_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: how the vocabulary's authors cut text into pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters fed at once; matches that reach the end of a block wait for the next one.
BLOCK = 1 << 16
#: How many pieces a worker remembers with the ids the transducer gave them, so that a repeated word is read once.
REMEMBERED = 400_000


class Merges:
    """A vocabulary as ranks: which tokens may follow each other, and how far a token may still reach."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.rank.values()) + 1)
        self.endings = ahocorasick.Automaton()  # the tokens that end at each byte, the longest first
        for t, i in self.rank.items():
            self.bytes[i] = t
            self.endings.add_word(t.decode("latin-1"), (i, len(t)))
        self.endings.make_automaton()
        self.lookahead = max(map(len, self.rank))
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}

    @functools.cached_property
    def open(self) -> frozenset[bytes]:
        """Bytes that a longer token may begin with: while the text ends in some, what comes before is undecided."""
        return frozenset(t[:n] for t in self.rank for n in range(1, len(t)))

    def merged(self, piece: bytes, below: int = 1 << 60) -> list[int]:
        """Ids of a piece by running the merges, in order of rank, up to those of a rank: the definition that all else follows."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.rank.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def made_of(self, t: int) -> tuple[int, int] | None:
        """The two tokens that the merges put together to ``t``; None for a single byte and for a token they never make."""
        if t not in self.halves:
            two = self.merged(self.bytes[t], t)
            self.halves[t] = (two[0], two[1]) if len(two) == 2 else None
        return self.halves[t]

    def reachable(self, t: int) -> bool:
        return len(self.bytes[t]) == 1 or self.made_of(t) is not None

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge across their bound comes before the merges that make the two.

        Their making is undone step by step, the later merge first. Of the tokens that touch the bound at each moment,
        none may be put together before the left one, or the right one, has become part of a longer token.
        """
        key = a << 32 | b
        ok = self.pairs.get(key)
        if ok is not None:
            return ok
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        x, y, left, right = a, b, 1 << 60, 1 << 60
        while True:
            across = self.rank.get(self.bytes[x] + self.bytes[y])
            if across is not None and across < left and across <= right:
                ok = False
                break
            undo_left = len(self.bytes[x]) > 1 and (x > y or len(self.bytes[y]) == 1)
            if undo_left:
                left, x = x, self.made_of(x)[1]
            elif len(self.bytes[y]) > 1:
                right, y = y, self.made_of(y)[0]
            else:
                ok = True
                break
        self.pairs[key] = ok
        return ok

    def encode(self, piece: str) -> list[int]:
        """Ids of one piece; one seen before is not read again."""
        ids = self.known.get(piece)
        if ids is None:
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.rank.get(data)  # the vocabulary's authors take such a piece as its token
            if whole is not None:
                ids = [whole]
            else:
                t = Transducer(self)
                ids = [*t.feed(data), *t.end()]
            if len(piece) <= 256:
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                self.known[piece] = ids
        return ids


class Transducer:
    """Bytes of one piece in, stable ids out; its memory is bounded by the vocabulary's longest token."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.kept = b""  # bytes from the last stable token's end on, and before it as many as the longest token has
        self.at = self.base = 0  # bytes read; all before is emitted
        self.last: dict[int, tuple[int, int]] = {}  # of each prefix that may still matter: its last token, where that begins

    def feed(self, data: bytes) -> Iterator[int]:
        step = self.m.lookahead
        for i in range(0, len(data), step):
            self._read(data[i : i + step])
            if self.at - self.base > step:
                yield from self._stable()

    def _read(self, data: bytes) -> None:
        """The last token of every new prefix."""
        m, last, pairs = self.m, self.last, self.m.pairs
        text = self.kept + data
        shift, seen = self.at - len(self.kept), self.at
        for end, (t, n) in m.endings.iter(text.decode("latin-1")):
            p = end + 1 + shift
            if p <= seen or p in last:
                continue
            start = p - n
            if start == 0:
                if m.reachable(t):
                    last[p] = (t, 0)
            elif (before := last.get(start)) is not None:
                ok = pairs.get(before[0] << 32 | t)
                if ok or ok is None and m.reachable(t) and m.compatible(before[0], t):
                    last[p] = (t, start)
        self.at += len(data)
        self.kept = text

    def _stable(self) -> Iterator[int]:
        """Emits what the encodings of all prefixes at which the token over the next byte may begin have in common."""
        text, at, most = self.kept, self.at, self.m.lookahead
        meet = {at} | {at - n for n in range(1, min(most, len(text)) + 1) if at - n >= self.base and text[-n:] in self.m.open}
        while len(meet) > 1:
            top = max(meet)
            meet.discard(top)
            meet.add(max(self.last[top][1], self.base) if top > self.base else self.base)
        p = meet.pop()
        yield from self._back(p)
        low = at - 2 * most
        self.kept = text[-2 * most :]
        for q in [q for q in self.last if q < min(self.base, low)]:
            del self.last[q]

    def _back(self, p: int) -> Iterator[int]:
        out, q = [], p
        while q > self.base:
            t, q = self.last[q]
            out.append(t)
        self.base = max(p, self.base)
        return reversed(out)

    def end(self) -> Iterator[int]:
        yield from self._back(self.at)


class Encoder:
    """Text in, ids out, block by block. A piece that spans blocks goes to a transducer, so that memory stays constant."""

    _GROW = {"L": regex.compile(r"\p{L}+"), "N": regex.compile(r"\p{N}+"), "O": regex.compile(r"[^\s\p{L}\p{N}]+")}

    def __init__(self, merges: Merges):
        pieces = regex.compile(PIECES)
        self.m, self.find, self.every = merges, pieces.finditer, pieces.findall

    def blocks(self, text: str, size: int = BLOCK) -> Iterator[int]:
        """Ids of a text of any length; ``size`` changes memory, never the ids."""
        if len(text) <= size:
            yield from self.ids(text)
            return
        rest, i, open_, kind = "", 0, None, ""
        while i < len(text) or rest:
            part, i = rest + text[i : i + size], i + size
            final, rest = i >= len(text), ""
            if open_ is not None:  # a piece is open: its class goes on as long as it does
                more = self._GROW[kind].match(part)
                n = more.end() if more else 0
                yield from open_.feed(part[:n].encode("utf-8", "surrogatepass"))
                if n == len(part) and not final:
                    continue
                yield from open_.end()
                open_, part = None, part[n:]
            for x in self.find(part):
                if x.end() < len(part) - 2 or final:
                    yield from self.m.encode(x.group())
                    continue
                s, kind = x.group(), self._kind(x.group())
                if kind and len(s) > 64:
                    open_ = Transducer(self.m)
                    yield from open_.feed(s.encode("utf-8", "surrogatepass"))
                    if x.end() < len(part):  # it has ended, with a character or two after it
                        yield from open_.end()
                        open_, rest = None, part[x.end() :]
                else:
                    rest = part[x.start() :]
                break

    def _kind(self, s: str) -> str:
        c = s[-1]
        return "" if c.isspace() else next(k for k, p in self._GROW.items() if p.fullmatch(c))

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        encode, known = self.m.encode, self.m.known
        for piece in self.every(text):
            out += known.get(piece) or encode(piece)
        return out


class Decoder:
    """Ids in, text out: keeps at most the three bytes of an unfinished character."""

    def __init__(self, merges: Merges):
        self.m, self.open, self.need = merges, b"", 0

    def feed(self, i: int) -> str:
        out = []
        for b in self.m.bytes[i]:
            if self.need and b & 0xC0 == 0x80:
                self.open, self.need = self.open + bytes([b]), self.need - 1
                if not self.need:
                    out.append(self.open.decode("utf-8", "replace"))
                    self.open = b""
                continue
            if self.need:
                out.append("�")
                self.open, self.need = b"", 0
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b < 0xF5:
                self.open, self.need = bytes([b]), 1 if b < 0xE0 else 2 if b < 0xF0 else 3
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        out, self.open, self.need = "�" if self.need else "", b"", 0
        return out


@functools.cache
def merges(path: str) -> Merges:
    """One vocabulary in each worker."""
    return Merges(path)


def _encoder_udf(path: str, count: bool):
    @F.pandas_udf(IntegerType() if count else ArrayType(IntegerType()))
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = Encoder(merges(path))
        for s in texts:
            if count:
                yield s.map(lambda t: sum(1 for _ in e.blocks(t)) if t else 0).astype("int32")
            else:
                yield s.map(lambda t: list(e.blocks(t)) if t else [])

    return encode


def token_ids(text: Column, tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k") -> Column:
    """The ids of ``text``, without special tokens; a special token's name in a text is ordinary text.

    The ids of empty and of null texts are the empty list.
    """
    return _encoder_udf(f"{tokenizers}/{vocabulary}.tiktoken", False)(text)


def token_count(text: Column, tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k") -> Column:
    """The number of ids that ``token_ids`` gives: 0 for empty and null texts."""
    return _encoder_udf(f"{tokenizers}/{vocabulary}.tiktoken", True)(text)


def decodes(ids: Column, text: Column, tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k") -> Column:
    """Whether decoding ``ids`` gives ``text`` back; null counts as the empty text."""
    path = f"{tokenizers}/{vocabulary}.tiktoken"

    @F.pandas_udf(BooleanType())
    def check(a: pd.Series, b: pd.Series) -> pd.Series:
        m = merges(path)

        def same(ids, text):
            d = Decoder(m)
            return "".join([*map(d.feed, ids), d.end()]) == (text or "")

        return pd.Series([same(i, t) for i, t in zip(a, b)], dtype=bool)

    return check(ids, text)


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of every row; repeated rows each have theirs. No shuffle: one pass over the table."""
    return documents.select(key, token_ids(F.col(text), tokenizers).alias("ids"))
