"""Oversized items cut into pieces under a limit by recursive bisection at natural boundaries."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

LIMIT, OVERLAP = 350, 50

#: Where a text may be cut, strongest first; a cut lies at the end of the match.
BOUNDARIES = [r"\n[ \t]*\n\s*", r"\n(?=#)", r"\n", r"[.!?…。！？।॥][\"'”’)\]]*\s+", r"[;:,،、，][ \t]+|\s[–—|·•]\s", r"\s+"]
_BOUNDARIES = [regex.compile(b) for b in BOUNDARIES]
#: How far from the midpoint a boundary is looked for, in shares of the stretch, before a weaker one is taken.
REACH = (1 / 6, 1 / 3, 0.49)


def tokens(text: Column) -> Column:
    """The project's estimate: floor((chars - nonascii) / 4 + nonascii / 2) + 1, in code points. Null stays null."""
    other = F.length(F.regexp_replace(text, "[\\x00-\\x7F]+", ""))
    return F.floor((F.length(text) + other) / 4).cast("int") + 1


def _cuts(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quarter tokens before each character; positions of boundaries and their strengths."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    weight = np.concatenate([[0], np.cumsum(1 + (points > 127))])
    best: dict[int, int] = {}
    for strength, b in zip(range(len(_BOUNDARIES), 0, -1), _BOUNDARIES):
        for x in b.finditer(text):
            best.setdefault(x.end(), strength)
    best.pop(0, None)
    best.pop(len(text), None)
    at = np.array(sorted(best), dtype=np.int64)
    return weight, at, np.array([best[int(p)] for p in at], dtype=np.int64)


def _joined(text: str, i: int) -> bool:
    """Whether a cut before character i would part a character from its marks."""
    c = text[i]
    return unicodedata.category(c)[0] == "M" or c in "‍️" or text[i - 1] == "‍" or "\udc00" <= c <= "\udfff" or unicodedata.combining(text[i - 1]) == 9


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(first, start, end) of each piece: the piece is text[first:end], of which text[first:start] repeats the one before.

    Each piece has at most ``limit`` tokens and each overlap at most ``overlap``; the parts [start:end] make up the text.
    """
    weight, at, strength = _cuts(text)
    most, own = 4 * limit - 1, 4 * (limit - overlap)  # quarter tokens

    def cut(a: int, b: int) -> int:
        half, span = (weight[a] + weight[b]) / 2, weight[b] - weight[a]
        for reach in REACH:
            lo = int(np.searchsorted(weight, half - reach * span))
            hi = int(np.searchsorted(weight, half + reach * span, side="right")) - 1
            i, j = np.searchsorted(at, max(lo, a + 1)), np.searchsorted(at, min(hi, b - 1), side="right")
            if i < j:
                near = np.lexsort((at[i:j], np.abs(weight[at[i:j]] - half), -strength[i:j]))
                return int(at[i + near[0]])
        mid = int(np.clip(np.searchsorted(weight, half), a + 1, b - 1))
        for step in range(64):  # no boundary at all: between whole characters, as near as may be
            for p in (mid - step, mid + step):
                if a < p < b and not _joined(text, p):
                    return p
        return mid

    out: list[tuple[int, int]] = []
    stack = [(0, len(text))]
    while stack:
        a, b = stack.pop()
        if weight[b] - weight[a] <= (most if (a, b) == (0, len(text)) else own) or b - a < 2:
            out.append((a, b))
        else:
            p = cut(a, b)
            stack += [(p, b), (a, p)]
    result = []
    for k, (a, b) in enumerate(out):
        first = a
        if k:
            room = min(4 * overlap - 1, most - int(weight[b] - weight[a]))
            low = max(out[k - 1][0], int(np.searchsorted(weight, weight[a] - room)))
            i, j = np.searchsorted(at, low), np.searchsorted(at, a)
            if i < j:  # begin at the strongest boundary within reach, the earliest of them
                first = int(at[i + int(np.argmax(np.where(strength[i:j] >= 3, 2, 1)))])
            else:
                first = next((p for p in range(low, a) if p == 0 or not _joined(text, p)), a)
        result.append((first, a, b))
    return result


_PIECE = StructType([StructField(n, IntegerType()) for n in ("first", "start", "end")])


def split_oversized(rows: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``rows`` with one row for each piece of ``text``: ``piece`` (from 0, in order), ``n_pieces``, ``piece_text``, ``overlap_chars``, ``piece_tokens``.

    A text within the limit, an empty and a null one give one piece, unchanged. Only oversized texts travel to Python,
    and only offsets come back. Columns of these names in ``rows`` are replaced; repeated rows are split each.
    """

    @F.pandas_udf(ArrayType(_PIECE))
    def offsets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: None if t is None else [dict(zip(("first", "start", "end"), p)) for p in pieces(t, limit, overlap)])

    names = ["piece", "n_pieces", "piece_text", "overlap_chars", "piece_tokens"]
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in names or c == text]
    t = F.col(text)
    whole = F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("start"), F.length(F.coalesce(t, F.lit(""))).alias("end")))
    cut = rows.select(*kept, F.coalesce(offsets(F.when(tokens(t) > limit, t)), whole).alias("_cut"))
    cut = cut.select("*", F.size("_cut").alias("n_pieces"), F.posexplode("_cut").alias("piece", "_p"))
    body = F.when(F.col("n_pieces") == 1, t).otherwise(F.substring(t, F.col("_p.first") + 1, F.col("_p.end") - F.col("_p.first")))
    cut = cut.withColumn("piece_text", body).withColumn("overlap_chars", F.col("_p.start") - F.col("_p.first"))
    return cut.withColumn("piece_tokens", tokens(F.col("piece_text"))).drop("_cut", "_p")
