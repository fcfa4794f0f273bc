"""Confusables skeleton: one form for all texts that look the same."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftmill.shared import staged

# Letters of other scripts and the Latin letter (or sign) of the same shape.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԁ": "D", "Ӏ": "I", "Ғ": "F", "а": "a", "с": "c", "е": "e",
    "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    "ԁ": "d", "ӏ": "l", "Ѵ": "V", "Ь": "b", "г": "r", "ո": "n",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j", "γ": "y",
    "Ϲ": "C", "Ϳ": "J", "Ϝ": "F", "η": "n", "σ": "o", "ω": "w",
}
OTHER = {
    "Տ": "S", "Օ": "O", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Ա": "U", "Լ": "L", "ı": "i", "ɑ": "a", "ɡ": "g",
    "ɩ": "i", "ʏ": "y", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M", "ℓ": "l",
}
#: Hyphens of every kind, all like "-". Dashes that are longer to the eye (U+2013, U+2014) are not among them.
HYPHENS = "\u2010\u2011\u2043\u02d7\u058a\u1806\ufe63\uff0d\u2212"


def _table() -> dict[int, str]:
    """Prototype of every character that has one, from the lists above and the character database."""
    out: dict[int, str] = {}
    for i in chain(range(0x80, 0xD800), range(0xF900, 0x10000), range(0x1D400, 0x1D800), range(0xE0000, 0xE01F0)):
        ch = chr(i)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Cs", "Co", "Lo") and not 0xFF00 <= i < 0xFFF0:
            continue
        form = unicodedata.decomposition(ch)
        tag, _, rest = form.partition("> ")
        if kind == "Zs":
            out[i] = " "
        elif kind == "Cf" and i not in (0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x8E2) or 0xFE00 <= i <= 0xFE0F or 0xE0100 <= i <= 0xE01EF or i in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164):
            out[i] = ""
        elif tag in ("<wide", "<narrow", "<font", "<compat") and (tag != "<compat" or 0xFB00 <= i <= 0xFB17 or 0x132 <= i <= 0x133 or 0x1C4 <= i <= 0x1CC or 0x1F1 <= i <= 0x1F3 or i == 0x17F):
            out[i] = "".join(chr(int(x, 16)) for x in rest.split())
    out |= {ord(k): v for t in (CYRILLIC, GREEK, OTHER) for k, v in t.items()}
    out |= {ord(c): "-" for c in HYPHENS}
    out[0x9] = " "
    return out


class Letters(dict):
    """A table for ``str.translate``: letters and marks stay, all else becomes ``other``; each character is looked up once."""

    def __init__(self, other: int | None):
        self.other = other

    def __missing__(self, point: int) -> int | None:
        self[point] = out = point if unicodedata.category(chr(point))[0] in "LM" else self.other
        return out


_PROTOTYPE: dict[int, str] = {}
_REPLACED: set[str] = set()
_LINE_END = re.compile("\r\n|[\u2028\u2029\x85]")


def skeleton(text: str) -> str:
    """The form that all texts looking like ``text`` share: decompose, replace by prototypes, decompose again.

    Accents, digits, superscripts, fractions and words stay apart; line breaks stay. The skeleton of "" is "".
    """
    if text.isascii():
        return text.replace("\t", " ").replace("\r\n", "\n") if "\t" in text or "\r" in text else text
    if not _PROTOTYPE:
        _PROTOTYPE.update(_table())
        _REPLACED.update(map(chr, _PROTOTYPE))
    text = unicodedata.normalize("NFD", _LINE_END.sub("\n", text))
    return unicodedata.normalize("NFD", text.translate(_PROTOTYPE)) if not _REPLACED.isdisjoint(text) else text


@F.pandas_udf(StringType())
def skeleton_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: None if t is None else skeleton(t))


def with_skeleton(rows: DataFrame, text: str = "text", into: str = "consistent_text") -> DataFrame:
    """``rows`` with the consistent form of ``text`` in ``into`` (an existing column of that name is replaced)."""
    return rows.withColumn(into, skeleton_udf(F.col(text)))


def lookalike_pairs(rows: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id_a, id_b), smaller first: rows whose texts look the same but are made of different characters.

    Null and empty texts and texts of invisible characters form no pair; nor do identical texts. Texts travel as 128-bit
    digests. Different texts of one skeleton are joined first, then the rows that have them, so that copies of a text are
    never held against each other and the work grows with the pairs that come out.
    """
    skel = skeleton_udf(F.col(text))
    d = rows.filter(f"{text} is not null and {text} <> '' and {key} is not null").select(F.col(key).alias("id"), F.md5(F.col(text).cast("binary")).alias("own"), skel.alias("s"))
    d = staged(d.filter("trim(s) <> ''").select("id", "own", F.md5(F.col("s").cast("binary")).alias("look")), "looks")
    forms = d.groupBy("look", "own").agg(F.count("*").alias("n"))
    mixed = staged(forms.join(forms.groupBy("look").agg(F.count("*").alias("forms")).filter("forms > 1"), "look", "left_semi"), "forms")
    a, b = mixed.select("look", F.col("own").alias("own_a")), mixed.select("look", F.col("own").alias("own_b"))
    unlike = a.join(b, "look").filter("own_a < own_b").select("own_a", "own_b")  # each gives at least one pair
    left = d.select(F.col("id").alias("i"), F.col("own").alias("own_a"))
    right = d.select(F.col("id").alias("j"), F.col("own").alias("own_b"))
    pairs = unlike.join(left, "own_a").join(right, "own_b").filter("i <> j")
    return pairs.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()
