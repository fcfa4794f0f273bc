"""Text expressions: hashes, scripts, years, tokens, coverage."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scripts by language, as ranges of code points, in order of precedence.
SCRIPTS = {
    "gu": (0x0A80, 0x0AFF), "hi": (0x0900, 0x097F), "bn": (0x0980, 0x09FF), "pa": (0x0A00, 0x0A7F), "or": (0x0B00, 0x0B7F), "ta": (0x0B80, 0x0BFF),
    "te": (0x0C00, 0x0C7F), "kn": (0x0C80, 0x0CFF), "ml": (0x0D00, 0x0D7F), "ur": (0x0600, 0x06FF),
}
# Words that carry no topic. Words of one site's own name are a parameter of the tokenizer.
STOPWORDS = """
    a an the of in on at to for from by with and or is are was were be been being do does did what which who whom whose when where why how can could
    should would will shall may might i me my we our you your it its this that these those there here about as into than then please tell know give
    college st sir madam mam maam miss mr mrs ms dr prof
""".split()


def text_hash(text: Column) -> Column:
    """SHA-256 of the text with white space collapsed and trimmed."""
    return F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256)


def count_in(text: Column, chars: str) -> Column:
    """How many characters of ``text`` lie in a character class."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))


def script_language(text: Column, default: str = "en", head: int = 5000) -> Column:
    """Language by script over the first characters: the commonest script if it has 0.3 times as many letters as Latin.

    Equal counts go to the earlier script of ``SCRIPTS``; texts without letters give ``default``, null gives null.
    """
    part = F.substring(text, 1, head)
    latin = count_in(part, "A-Za-z")
    counts = F.array(*[F.struct(count_in(part, f"\\x{{{a:x}}}-\\x{{{b:x}}}").alias("n"), F.lit(-i).alias("at"), F.lit(lang).alias("lang")) for i, (lang, (a, b)) in enumerate(SCRIPTS.items())])
    top = F.array_max(counts)
    return F.when(text.isNull(), None).when(top["n"] == 0, F.when(latin == 0, default).otherwise("en")).when(top["n"] >= latin * 0.3, top["lang"]).otherwise("en")


def academic_year(text: Column, head: int = 4000) -> Column:
    """The first "2025-26" or "2025-2026" whose years follow each other, as "2025-26"; null where there is none."""
    found = F.regexp_extract_all(F.substring(text, 1, head), F.lit(r"\b(20\d{2}\s*[-–/]\s*(?:20)?\d{2})\b"), F.lit(1))
    ok = F.filter(found, lambda x: (F.substring(x, 1, 4).cast("int") + 1) % 100 == F.right(x, F.lit(2)).cast("int"))
    return F.when(F.size(ok) > 0, F.concat(F.substring(ok[0], 1, 4), F.lit("-"), F.right(ok[0], F.lit(2))))


def tokens(text: Column, own: Sequence[str] = ()) -> Column:
    """Search terms: lower case, dotted initials joined, thousands separators dropped; runs of a-z and digits, or of other
    letters; no stop words (nor ``own``), no single letters. Null gives null."""
    t = F.lower(text)
    t = F.regexp_replace(t, r"\b([a-z])\.(?=[a-z]\b|[a-z]{2,}\b)", "$1")
    t = F.regexp_replace(t, r"(?<=\d)[,\s](?=\d{3}\b)", "")
    found = F.regexp_extract_all(t, F.lit(r"[a-z0-9]+|[\p{L}\p{Nl}\p{No}&&[^a-z]]+"), F.lit(0))
    return F.filter(found, lambda x: ~x.isin(*STOPWORDS, *own) & ((F.length(x) > 1) | x.between("0", "9")))


def estimated_tokens(text: Column) -> Column:
    """About 4 plain or 2 other characters a token, and one."""
    other = F.length(F.regexp_replace(text, r"[\x00-\x7F]+", ""))
    return F.floor((F.length(text) + other) / 4).cast("int") + 1


def coverage(query: Column, text: Column, own: Sequence[str] = (), spelled: Mapping[str, str] = {}) -> Column:
    """Share of the query's distinct terms that the text has; 0 for a query without terms.

    A short form of ``spelled`` (form: meaning) is covered also where the text has all longer words of its meaning.
    """
    q, t = F.array_distinct(tokens(query, own)), F.array_distinct(tokens(text, own))
    hit = F.size(F.array_intersect(q, t))
    for short, meaning in spelled.items():
        full = F.array(*[F.lit(w) for w in re.findall("[a-z0-9]+", meaning.lower()) if w != short and len(w) > 2 and w not in STOPWORDS])
        hit = hit + F.when(F.array_contains(q, short) & ~F.array_contains(t, short) & (F.size(full) > 0) & (F.size(F.array_except(full, t)) == 0), 1).otherwise(0)
    return F.when(F.size(q) > 0, hit / F.size(q)).otherwise(F.lit(0.0))


def sanitized(text: Column) -> Column:
    """Without zero-width and bidi marks; one kind of line end, single spaces, one blank line at most; trimmed."""
    t = F.regexp_replace(text, "[\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}\\x{feff}\\x{ad}]", "")
    t = F.regexp_replace(F.regexp_replace(t, "\r\n?", "\n"), "[ \t\\x{a0}]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, " *\n *", "\n"), "\n{3,}", "\n\n"))


def unreadable(text: Column) -> Column:
    """Whether at least 20 signs stand there and over 30 % are replacement or private-use characters."""
    bare = F.regexp_replace(text, r"\s+", "")
    return (F.length(bare) >= 20) & (count_in(bare, "\\x{fffd}\\x{e000}-\\x{f8ff}") > 0.3 * F.length(bare))


def sniffed(content: Column) -> Column:
    """Kind of a file by its first bytes: pdf, docx, image, or null."""
    h = F.hex(F.substring(content, 1, 8))
    word = F.hex(F.substring(content, 1, 4000)).contains("776F72642F")
    return F.when(h.startswith("25504446"), "pdf").when(h.startswith("89504E47") | h.startswith("FFD8FF"), "image").when(h.startswith("504B") & word, "docx")
