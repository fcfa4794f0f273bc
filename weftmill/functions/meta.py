"""Titles, dates, labels and languages of sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftmill.functions import urls
from weftmill.functions.dates import MONTHS, instant_micros
from weftmill.functions.text import SCRIPTS, count_in

# Link texts that name nothing.
GENERIC_TITLES = r"(?i)^\W*(click here|download( pdf| here)?|here|view( more| all| pdf| file)?|read more|more|open|pdf|link|file|details|know more|show|see here)\W*$"


def clean_title(text: Column) -> Column:
    """Without tags, with the usual entities unescaped and single spaces."""
    t = F.regexp_replace(text, "<[^>]*>", "")
    for name, sign in (("&nbsp;", " "), ("&#8211;", "–"), ("&#8217;", "’"), ("&quot;", '"'), ("&#0?39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.regexp_replace(t, name, sign)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def document_title(url: Column, *candidates: Column) -> Column:
    """The first candidate that names the document, else a title made of the file's name; at most 300 characters.

    One names it if it has at least 6 characters, is no generic link text, no "untitled", and not the file's name again.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    name = urls.title_from_url(url)
    out = []
    for c in candidates:
        t = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?i)^Microsoft (Word|Excel|PowerPoint)\s*-\s*", "")
        t = F.trim(F.regexp_replace(t, r"(?i)\.(docx?|xlsx?|pptx?|pdf)$", ""))
        good = (F.length(t) >= 6) & ~t.rlike(GENERIC_TITLES) & (plain(t) != plain(name)) & ~t.rlike(r"(?i)^(untitled|document\d*)\b")
        out.append(F.when(good, F.substring(t, 1, 300)))
    return F.coalesce(*out, name)


def upload_micros(url: Column) -> Column:
    """The first of the month in an upload path, in microseconds; null if there is none or the month is none."""
    y, m = F.regexp_extract(url, urls.UPLOADED, 1), F.regexp_extract(url, urls.UPLOADED, 2)
    return instant_micros(F.when(y != "", F.concat_ws("-", y, m, F.lit("01"))))


def stated_micros(text: Column, head: int = 1500) -> Column:
    """A "Date: 12/06/2026" or "dated 12 June 2026" near the top, day first, from 2000 to 2100; else null."""
    part = F.substring(text, 1, head)
    numeric = r"(?i)\bdated?\s*[:\-]?\s*(\d{1,2})[./-](\d{1,2})[./-]((?:20)?\d{2})\b"
    worded = r"(?i)\bdated?\s*[:\-]?\s*(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3})[a-z]*,?\s+(20\d{2})"
    at = lambda p, i: F.regexp_extract(part, p, i)
    year = F.when(F.length(at(numeric, 3)) == 2, F.concat(F.lit("20"), at(numeric, 3))).otherwise(at(numeric, 3))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(at(worded, 2))).cast("string")
    return F.when(at(numeric, 1) != "", instant_micros(F.concat_ws("-", year, at(numeric, 2), at(numeric, 1)))).when(at(worded, 1) != "", instant_micros(F.concat_ws("-", at(worded, 3), month, at(worded, 1))))


def best_micros(meta: Column, url: Column, text: Column) -> Column:
    """The most reliable date: the page's own, then its upload path's, then one stated in the text."""
    return F.coalesce(instant_micros(meta), upload_micros(url), stated_micros(text))


def chunk_header(section: Column, title: Column) -> Column:
    """"Section › Title", or the section alone if it names the title."""
    s, t = F.trim(F.coalesce(section, F.lit(""))), F.trim(F.coalesce(title, F.lit("")))
    return F.when(s == "", t).when((t == "") | s.contains(t), s).otherwise(F.concat_ws(" › ", s, t))


def source_label(title: Column, section: Column, academic_year: Column, url: Column, content_type: Column) -> Column:
    """A short name: the title without link words, its year if it names none, and for web pages their host."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?i)\b(click here( to)?|view|download|read more)\b", ""), r"\s+", " "))
    t = F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 100_000))
    part = F.trim(F.element_at(F.split(F.coalesce(section, F.lit("")), "›"), -1))
    bare = F.regexp_replace(t, r"(?i)academic|year|[\d\s–—/-]", "") == ""
    year = F.coalesce(academic_year, F.lit(""))
    t = F.when((t != "") & bare & (part != ""), F.trim(F.concat_ws(" ", part, F.when(year != "", year).otherwise(t)))).otherwise(t)
    t = F.when((t != "") & (year != "") & ~t.rlike(r"(19|20)\d{2}"), F.concat_ws(" ", t, year)).otherwise(t)
    return F.when((content_type == "html") & (t != ""), F.concat(t, F.lit(" page, "), urls.host(url))).otherwise(t)


def typed_language(text: Column, preferred: Column | None = None) -> Column:
    """The language of the script a text is written in, else en: a script needs 2 letters and 30 % of all letters.

    Devanagari is mr if that is preferred. Null and texts without letters are en.
    """
    letters = F.size(F.regexp_extract_all(text, F.lit(r"\p{L}"), F.lit(0)))
    counts = F.array(*[F.struct(count_in(text, f"\\x{{{a:x}}}-\\x{{{b:x}}}").alias("n"), F.lit(-i).alias("at"), F.lit(lang).alias("lang")) for i, (lang, (a, b)) in enumerate(SCRIPTS.items())])
    top = F.array_max(counts)
    lang = F.when(text.isNull() | (letters == 0) | (top["n"] < F.greatest(F.lit(2.0), letters * 0.3)), "en").otherwise(top["lang"])
    if preferred is not None:
        lang = F.when((lang == "hi") & (preferred == "mr"), "mr").otherwise(lang)
    return F.coalesce(lang, F.lit("en"))


def answer_language(selected: Column, question: Column) -> Column:
    """What was typed beats what was selected."""
    typed = typed_language(question, selected)
    return F.when(typed != "en", typed).otherwise(F.coalesce(selected, F.lit("en")))
