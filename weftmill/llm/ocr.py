"""Noise in text from scanned pages: broken words, misread characters, running headers and page numbers.

The body lines of a text are joined to one stream of characters without line ends. A lattice over that stream has an edge
for every reading of every stretch: a word as it stands, a word with confused characters, parts joined over hyphens and
gaps (also several of both in one word), and a stretch cut into several words. All edges have costs in bits, from the counts
of words over all texts and, for rare words such as names, from counts of letter triples; the cheapest path is the text. A
second dynamic program over the lines chooses the paragraphs.
"""

from __future__ import annotations

import difflib
import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from weftmill.llm.skeleton import Letters, skeleton
from weftmill.shared import staged

#: Words that make up this share of all words go to every worker: at most 1 / SHARE, however large the corpus. Rarer ones
#: are looked up by joins, with their exact counts.
SHARE = 5e-6
#: Bits: of a confusion of characters, of a rare word's confusion by its letters (which then needs 40 times as many words with
#: its rarest triple), of a gap within a word, of a missing gap, of a compound that is in no text, of a hyphen that joins nothing.
FIX, FIX_BY_LETTERS, GAP, NO_GAP, COMPOUND, APART = 3.0, math.log2(40), 6.0, 8.0, 4.0, 14.0
#: How often a word must stand in all texts for another to be read as it; one that stands less often may be several without gaps.
LEAST = 3
#: Words read over gaps or without them make up at least this share of all words.
PLAIN = 5e-5
#: How many times as often as each of its parts a word must stand for them to be read as it over gaps. Parts are counted
#: where they stand, so that all have some count.
OFTENER = 2**GAP

# What scanners read (left) for what stands there (right).
CONFUSIONS = """
    rn m | cl d | ii u | vv w | ri n | li h | tl d | nn m | c e | f t | l i | b h | q g | h b | I l | m in | f e | m ni
    1 l | 1 i | 0 o | 5 s | @ a | 8 b | 6 b | 9 g | | l | $ s | ! i | 3 e | 2 z | 4 a | 7 t | € e | £ l | ° o
"""  # fmt: skip
_PAIRS = [tuple(p.split()) for line in CONFUSIONS.strip().split("\n") for p in regex.split(r" \| (?=\S+ \S)", line.strip()) if len(p.split()) == 2]
#: Hyphens at a line's end. The last two are never part of a word.
_BREAK = regex.compile(r"(?<=[\p{L}\p{M}@0-9])([-‐‑­¬])[ \t]*$")
_BROKEN = frozenset("-‐‑\u00ad¬")
_TOKEN = regex.compile(r"[\p{L}\p{M}][\p{L}\p{M}\p{N}@|$!€£°]*(?:['’\-‐][\p{L}\p{M}\p{N}@]+)*|[\p{N}@|$!€£°]+[\p{L}][\p{L}\p{M}\p{N}@|$!€£°]*")
#: The same for lines of ASCII characters, which the plainer engine reads faster.
_ASCII_TOKEN = re.compile(r"[A-Za-z][A-Za-z0-9@|$!]*(?:['\-][A-Za-z0-9@]+)*|[0-9@|$!]+[A-Za-z][A-Za-z0-9@|$!]*")
_ODD = regex.compile(r"(?<=\p{L})[0-9@|$!€£°](?=\p{L})|^[0-9@|$€£°](?=\p{L}{2})|(?<=\p{L}{2})[0-9@|$€£°]$")
_ORDINAL = regex.compile(r"^\d+(?:st|nd|rd|th|am|pm|cm|mm|km|kg|mb|gb|px|x|e|er|ème|º|ª)$", regex.I)
_ROMAN = regex.compile(r"^(?=[ivxlc]+$)c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$", regex.I)
_PAGE = regex.compile(r"^(?:page|pg\.?|p\.|seite|página|pág\.|पृष्ठ|पान|પાનું)\s*\d+(?:\s*(?:of|/|von|de|sur)\s*\d+)?$|^\d+\s*(?:of|/)\s*\d+$|^\d+\s*\|\s*p\s*a\s*g\s*e$|^p\s*a\s*g\s*e\s*\|\s*\d+$|^[\[({<–—~•*-]+\s*\d+\s*[\])}>–—~•*-]+$", regex.I)
_NUMBER = regex.compile(r"^\d{1,4}$")
_MONEY = regex.compile(r"^(?:rs\.?\s*)?\d[\d,.]*(?:/-)?$", regex.I)
_END = regex.compile(r"[.!?।:;][\"”’)\]]*$")
_AROUND = regex.compile(r"^\s*(?:(?:page|p\.)\s*)?(?:\d+|[ivxlc]+)?\s*[|·—–-]?\s*|\s*[|·—–-]?\s*(?:(?:page|p\.)\s*)?(?:\d+|[ivxlc]+)?\s*$", regex.I)
#: A line with a number set apart at one end; a school's name alone.
_SPACED = regex.compile(r"^(?:\d{1,4}|[ivxl]{1,7})\s{2,}\p{Lu}[^.!?]{3,80}$|^(?:\d{1,4}\s*\|\s*)?\p{Lu}.{3,80}?(?:\s{2,}|\s*\|\s*)(?:\d{1,4}|[ivxl]{1,7})$")
_NUMBERED = regex.compile(r"^\d+\s{2,}\S|\S\s{2,}\d+$|^\d+\s+\p{Lu}.*[^\d,.]$|\|\s*\d+$|^\d+\s*\|")
_CLOSING, _DIGIT = ".!?।:;\"”’)]", re.compile(r"\d")
_DASH = regex.compile(r"\s[—–|]\s")
_SCHOOL = regex.compile(r"^(?:\p{Lu}[\p{L}@0-9.'’-]*\s+){1,4}(?:Co[l1]{2}ege|COLLEGE|Institute|INSTITUTE|Mahavidyalaya|MAHAVIDYALAYA|School of \p{Lu}\p{L}+|SCHOOL OF \p{Lu}+|University|UNIVERSITY|Academy|ACADEMY)$")
_FOLD = regex.compile(r"[^\p{L}]+")
_LETTERS = Letters(None)


_HYPHENS, _SOFT = re.compile("[-‐‑¬][ \t]*\n[ \t]*"), re.compile("\u00ad(?=[ \t]*\n)")


#: Words before which a hyphen stands for the second part of a compound.
SUSPENDED = "and or to und oder et ou y o e".split()


def words_of(text: str) -> tuple[Counter, list[str]]:
    """Words of a text in lower case, without those cut by a line's end, and the words that the cut ones may be."""
    flat = skeleton(_SOFT.sub("¬", text) if "\u00ad" in text else text).lower()
    joins, parts, last = [], [], 0
    for m in _HYPHENS.finditer(flat):
        a, e = m.span()
        if a and (flat[a - 1] == "@" or _is_sign(flat[a - 1], "")):
            b, c = a, e
            while b > last and _is_sign(flat[b - 1], "@|$!€£°'’-‐"):
                b -= 1
            while c < len(flat) and _is_sign(flat[c], "@|$!€£°"):
                c += 1
            if c > e:
                left, right = flat[b:a], flat[e:c]
                joins += (f"{left.rsplit('-', 1)[-1]}{right}", f"{left}-{right}")
            parts += (flat[last:b], "\n")
            last = c
    rest = "".join(parts) + flat[last:] if parts else flat
    return Counter((_ASCII_TOKEN if rest.isascii() else _TOKEN).findall(rest)), joins


def _is_sign(c: str, others: str) -> bool:
    """Whether a character is a letter, a digit, a mark or one of some others."""
    return c.isalnum() or c in others or c > "\x7f" and unicodedata.category(c)[0] == "M"


def is_odd(w: str) -> bool:
    """Whether a word holds signs that no word has."""
    return bool(_ODD.search(w) or len(w) == 2 and regex.match(r"^[01@]\p{L}$|^\p{L}[01@]$", w))


def readings(w: str, longest: int) -> Iterator[str]:
    """What may stand where ``w`` is read: one confusion, or two where it holds signs that no word has.

    Nothing for words longer than any word can be read to.
    """
    odd = not w.isalpha() and is_odd(w)
    if len(w) < 3 and not odd or len(w) > longest + 2 or _ORDINAL.match(w):
        return
    seen, level = {w}, [w]
    for _ in range(2 if odd else 1):
        after = []
        for x in level:
            for a, b in _PAIRS:
                at = x.find(a)
                while at >= 0:
                    y = x[:at] + b + x[at + len(a) :]
                    if y not in seen and (at or (a, b) != ("f", "e")):  # E is read as F within capitals
                        seen.add(y)
                        after.append(y)
                        yield y
                    at = x.find(a, at + 1)
        level = after


class Lexicon:
    """Counts of the words and letter triples of all texts, and what readings of a word cost by them.

    ``rare`` holds what was looked up for the text at hand: count, best reading and that one's count.
    """

    def __init__(self, counts: dict[str, int], triples: dict[str, int], total: int, longest: int | None = None):
        self.n, self.tri, self.total = counts, triples, max(1, total)
        self.longest = max(map(len, counts), default=0) if longest is None else longest
        self.rare: dict[str, tuple[int, str | None, int]] = {}
        self.known: dict[str, tuple[float, str | None]] = {}
        self.plain: dict[str, float] = {}  # bits of common words that have no other reading
        self.bits = math.log2(self.total)
        # beginnings of words that may stand apart from the rest: what is common itself is none
        self.begins = {w[:k] for w, n in counts.items() if n >= PLAIN * self.total for k in range(1, len(w)) if counts.get(w[:k], 0) * OFTENER <= n}

    def count(self, w: str) -> int:
        return self.n.get(w) or self.rare.get(w, (0,))[0]

    def cost(self, w: str) -> float:
        """Bits of a word; an unknown one costs more the longer it is."""
        n = self.n.get(w) or self.rare.get(w, (0,))[0]
        return self.bits - math.log2(n) if n else self.unknown(w)

    def unknown(self, w: str) -> float:
        """Bits of a word that is in no text."""
        return self.bits + 3 + 1.5 * len(w)

    def apart(self, parts: list[str], whole: str) -> bool:
        """Whether parts may be a plain word over gaps: each is much rarer than the word."""
        n = self.n.get(whole, 0)
        return all(self.count(x) * OFTENER <= n for x in parts)

    def rarest(self, w: str) -> int:
        s = f"^{w}$"
        return min(self.tri.get(s[i : i + 3], 0) for i in range(len(s) - 2))

    def fix(self, w: str) -> tuple[float, str | None]:
        """(bits it costs beyond the word as it stands, what else may stand there); the cheapest."""
        common = w in self.n
        if common and (got := self.known.get(w)):
            return got
        got = self._fix(w)
        if common:
            self.known[w] = got
        return got

    def _fix(self, w: str) -> tuple[float, str | None]:
        own = self.count(w)
        if w in self.n or w not in self.rare:
            best = max(readings(w, self.longest), key=lambda y: (self.n.get(y, 0), y), default=None)
            many = self.n.get(best, 0) if best else 0
        else:
            own, best, many = self.rare[w]
        options: list[tuple[float, str | None]] = [(math.inf, None)]
        if many >= LEAST:
            options.append((FIX - math.log2(many / max(1, own)), best))
        odd = not w.isalpha() and is_odd(w)
        if odd and len(w) > 2 and options[-1][0] > 0:  # letters alone, whatever they say
            plain = max((y for y in readings(w, self.longest) if y.isalpha()), key=lambda y: (self.rarest(y), y), default=None)
            options.append((-1.0, plain) if plain else (math.inf, None))
        if w.isalpha() and own <= 3 and own * 1e5 < self.total:
            y = max((y for y in readings(w, self.longest) if y.isalpha()), key=lambda y: (self.rarest(y), y), default=None)
            if y and (there := self.rarest(y)):
                options.append((FIX_BY_LETTERS - math.log2(there / (self.rarest(w) + 1)), y))
        return min(options, key=lambda o: o[0])


def _alike(a: str, b: str) -> bool:
    """Whether two keys are the same but for a few misread letters; letters are counted before they are aligned."""
    both = len(a) + len(b)
    if abs(len(a) - len(b)) > 0.2 * max(len(a), len(b)):
        return False
    if both and 2.0 * sum(min(a.count(c), b.count(c)) for c in set(b)) / both <= 0.88:
        return False
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() > 0.88


_EDGE = re.compile(r"^\s*(?:[\divxlcIVXLC|·—–-]|[Pp](?:age|\.)\b)|(?:[\divxlcIVXLC|·—–-]|[Pp](?:age|\.))\s*$")


def _header_key(line: str) -> str:
    flat = skeleton(line)
    if _EDGE.search(flat):
        flat = _AROUND.sub("", flat)
    return flat.lower().translate(_LETTERS)


def _page_lines(lines: list[str]) -> set[int]:
    """Lines that hold a page number alone."""
    flat = [skeleton(x).strip() for x in lines]
    # a page number has a digit, or is Roman and short
    sure = {i for i, x in enumerate(flat) if x and (_DIGIT.search(x) and _PAGE.match(x) or len(x) < 12 and _ROMAN.match(x) and x == x.lower())}
    cell = set()
    short = [i for i, x in enumerate(flat) if x and i not in sure]
    for a, b, c in zip(short, short[1:], short[2:]):
        if not _MONEY.match(flat[a]) and len(flat[a]) < 60 and _NUMBER.match(flat[b]) and _MONEY.match(flat[c]) and not _END.search(flat[a]):
            cell |= {b, c}
    bare = [i for i, x in enumerate(flat) if len(x) <= 4 and _NUMBER.match(x) and (len(x) <= 3 or i not in cell)]
    value = {i: int(flat[i]) for i in bare}
    # the longest run of numbers that count up by one; a table's cells join it only where they continue it
    best: dict[int, tuple[int, int | None]] = {}
    for i in bare:
        prev = [j for j in best if value[j] + 1 == value[i]]
        back = max(prev, key=lambda j: best[j], default=None) if prev else None
        best[i] = ((best[back][0] if back is not None else 0) + (1 if i not in cell else 0), back)
    chain: set[int] = set()
    if best:
        i: int | None = max(best, key=lambda k: (best[k][0], -k))
        if best[i][0]:
            while i is not None:
                if i not in cell:
                    chain.add(i)
                i = best[i][1]
    if len(chain) == 1 and sure:
        chain = set()
    return sure | chain


def _headers(lines: list[str], numbers: set[int], title: str, url: str) -> set[int]:
    """Running headers: lines beside a page break that say the title, the site's name, or what other such lines say."""
    keys = [_header_key(x) for x in lines]
    count = Counter(k for i, k in enumerate(keys) if k and i not in numbers and not lines[i].lstrip().startswith("#"))
    host = _FOLD.sub("", regex.sub(r"^\w+://", "", url or "").split("/")[0].lower())
    slug = _FOLD.sub("", regex.sub(r"-\w{1,4}(\.\w+)?/?$", "", (url or "").rstrip("/").split("/")[-1]).lower())
    said = _FOLD.sub("", skeleton(title or "").lower())
    first = next((i for i, x in enumerate(lines) if x.strip()), -1)
    out = set()
    for i, k in enumerate(keys):
        line = lines[i].strip()
        if len(k) < 3 or i in numbers or line.startswith(("#", "- ")) or line[-1] in _CLOSING and _END.search(line):
            continue
        numbered = bool(_DIGIT.search(line) and _NUMBERED.search(line))
        spaced = ("  " in line or "|" in line) and bool(_SPACED.match(line))
        same = lambda a: len(a) >= 6 and len(k) <= 2 * len(a) + 8 and (k == a or min(len(k), len(a)) >= 8 and (k.startswith(a) or a.startswith(k)) and min(len(k), len(a)) >= 0.6 * max(len(k), len(a)) or _alike(k, a))
        words = line.split()
        name = len(words) <= 7 and len(k) >= 5 and host and all(w[:1].isupper() or w.lower() in ("of", "and", "the") or not w[:1].isalpha() for w in words) and any(len(w) >= 5 and _FOLD.sub("", w.lower()) in host for w in words)
        near = bool({i - 1, i + 1} & numbers)
        part = _header_key(_DASH.split(line)[0]) if _DASH.search(line) else k
        starts = len(part) >= 8 and part != k and any(a.startswith(part) for a in (said, slug))
        if i != first and (words[-1][:1].isupper() and _SCHOOL.match(line) or starts) or spaced:
            out.add(i)
            continue
        if (same(said) or slug and same(slug)) and (i != first or numbered) or name and (i != first or numbered) or (count[k] >= 2 and (near or numbered) and not _cellish(lines, i, numbers)):
            out.add(i)
    return out


def _cellish(lines: list[str], i: int, numbers: set[int]) -> bool:
    """Whether a line names the row of a table whose cells have a line each."""
    after = next((x.strip() for j, x in enumerate(lines[i + 1 : i + 5], i + 1) if x.strip() and j not in numbers), "")
    return bool(_MONEY.match(after)) and len(lines[i].split()) <= 4


class Page:
    """What one text holds: kinds of its lines, and the text repaired."""

    def __init__(self, text: str, title: str | None, url: str | None, lexicon: Lexicon):
        self.lex = lexicon
        self.lines = text.split("\n")
        self.numbers = _page_lines(self.lines)
        self.headers = _headers(self.lines, self.numbers, title or "", url or "")
        self.numbers -= self.headers
        body = [i for i, x in enumerate(self.lines) if x.strip() and i not in self.numbers and i not in self.headers]
        self.kinds: dict[int, set[str]] = {i: {"page_number"} for i in self.numbers} | {i: {"header"} for i in self.headers}
        self.body = body
        self._decode()

    def _tag(self, i: int, kind: str) -> None:
        self.kinds.setdefault(i, set()).add(kind)

    def _decode(self) -> None:
        """Lays the words of the stream out with what parts them, and reads them by the cheapest path."""
        atoms: list[tuple[str, str, int, int, int]] = []  # (word, in lower case, line, start, end)
        joints: list[str] = []  # after each: a hyphen at the line's end, " " for a gap, "" for all else
        open_ = ""
        for i in self.body:
            raw = self.lines[i]
            m = _BREAK.search(raw) if raw.rstrip(" \t")[-1:] in _BROKEN else None
            flat = skeleton(raw[: m.start()] if m else raw)
            low = flat.lower()
            end = len(flat) - len(flat.lstrip())
            same, head = len(low) == len(flat), True
            for x in (_ASCII_TOKEN if flat.isascii() else _TOKEN).finditer(flat):
                a, b = x.span()
                if head:
                    if atoms:
                        joints.append(open_ if a == end else "")
                    head = False
                else:
                    joints.append(" " if b > a == end + 1 and flat[end] == " " else "")
                w = flat[a:b]
                atoms.append((w, low[a:b] if same else w.lower(), i, a, b))
                end = b
            open_ = m.group(1) if m and atoms and atoms[-1][2] == i and end == len(flat) else " " if atoms and end == len(flat.rstrip()) else ""
        joints.append("")
        self.joined: dict[int, str] = {}  # of a line: how its last word goes on: "" joined, "-" kept
        self.fixes: dict[int, list[tuple[int, int, str]]] = {}
        n = len(atoms)
        cost, back = [0.0] + [math.inf] * n, [None] * (n + 1)
        plain = self.lex.plain
        for i, (atom, joint) in enumerate(zip(atoms, joints)):
            sure = plain.get(atom[1])
            if sure is not None and (joint == " " or joint == ""):  # a common word without another reading has one edge
                c = cost[i] + sure
                if c < cost[i + 1]:
                    cost[i + 1], back[i + 1] = c, (i, "", None, "")
                continue
            for c, j, word, fix, how in self._edges(atoms, joints, i):
                if cost[i] + c < cost[j]:
                    cost[j], back[j] = cost[i] + c, (i, word, fix, how)
        i = n
        while i:
            j, word, fix, how = back[i]
            if fix is not None or i - j > 1:
                self._mark(word, atoms[j:i], joints[j : i - 1], fix, how)
            i = j

    def _edges(self, atoms: list, joints: list[str], i: int) -> Iterator[tuple[float, int, str, str | None, str]]:
        """(bits, end, word read, reading if another, how joined) of every edge that begins at an atom."""
        lex = self.lex
        word, w, *_ = atoms[i]
        joint = joints[i]
        tied = joint not in ("", " ")
        own, (more, fix) = lex.cost(w), lex.fix(w)
        cut = self._cut(w) if len(w) > 5 and lex.count(w) < LEAST and w.isalpha() else None
        if fix is None and cut is None and w in lex.n and w not in lex.begins:
            lex.plain[w] = own
        apart = 0.0
        if tied:  # a hyphen stays over if nothing is joined
            apart = (0.0 if atoms[i + 1][1] in SUSPENDED else math.inf if joint in "¬\u00ad" else APART)
        yield own + apart, i + 1, word, None, ""
        if fix:
            yield own + more + apart, i + 1, word, fix, ""
        if cut:  # held against a word that is in no text, since one so rare may be there by its missing gaps alone
            yield own + cut[0] - lex.unknown(w) + apart, i + 1, word, cut[1], ""
        if not tied and (joint != " " or w not in lex.begins or not w.isalpha()):
            return
        text, whole, bits, breaks, parts = word, w, 0.0, 0, [w]
        for j in range(i + 1, min(i + 4, len(atoms))):
            right, r = atoms[j][:2]
            joint = joints[j - 1]
            if not joint:
                return
            if joint == " ":
                bits, text, whole = bits + GAP, text + right, whole + r
                parts.append(r)
                if lex.n.get(whole, 0) >= PLAIN * lex.total and (breaks or lex.apart(parts, whole)):
                    yield bits + lex.cost(whole), j + 1, text, None, ""
                continue
            breaks += 1
            tail = whole.rsplit("-", 1)[-1]
            inner = right[:1].isupper() and not text.isupper()  # no word goes on in capitals
            if r not in SUSPENDED or joint in "¬\u00ad":
                if not inner or joint in "¬\u00ad":
                    c, (extra, other) = lex.cost(tail + r), lex.fix(tail + r)
                    yield bits + c, j + 1, text + right, None, ""
                    if other:
                        yield bits + c + extra, j + 1, text + right, whole[: len(whole) - len(tail)] + other, ""
                if joint not in "¬\u00ad":
                    both = f"{whole}-{r}"
                    c = min(lex.cost(both) if lex.count(both) else math.inf, lex.cost(whole) + lex.cost(r) + (0.0 if inner else COMPOUND))
                    yield bits + c, j + 1, f"{text}-{right}", None, "-"
                    extra, other = lex.fix(both)
                    if other and lex.count(other):
                        yield bits + lex.cost(both) + extra, j + 1, f"{text}-{right}", other, "-"
            text, whole = text + right, whole + r

    def _cut(self, w: str) -> tuple[float, str] | None:
        """(bits, words) of the cheapest cut of a stretch of letters into plain words, if there is any."""
        lex, least = self.lex, max(LEAST, PLAIN * self.lex.total)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(math.inf, 0)] * len(w)
        for b in range(1, len(w) + 1):
            for a in range(max(0, b - lex.longest), b - (0 if b < 3 else 2)):
                if best[a][0] < math.inf and lex.n.get(w[a:b], 0) >= least and b - a > 2:
                    best[b] = min(best[b], (best[a][0] + lex.cost(w[a:b]) + (NO_GAP if a else 0.0), a))
        if best[-1][0] == math.inf or best[-1][1] == 0:
            return None
        parts, b = [], len(w)
        while b:
            a = best[b][1]
            parts.append(w[a:b])
            b = a
        return best[-1][0], " ".join(reversed(parts))

    def _mark(self, word: str, atoms: list, joints: list[str], fix: str | None, how: str) -> None:
        """Notes what a reading says of its lines, and how it changes them."""
        for (_, _, line, _, _), joint in zip(atoms, joints):
            if joint != " ":
                self.joined[line] = how
                if not how:
                    self._tag(line, "hyphen")
        if len(atoms) > 1 and fix is None and any(j == " " for j in joints):
            fix = word.lower()
        if fix is None or " " in fix:
            if fix:
                at = [0, *itertools.accumulate(map(len, fix.split(" ")))]  # the letters stay as they are
                self.fixes.setdefault(atoms[0][2], []).append((atoms[0][3], atoms[0][4], " ".join(word[a:b] for a, b in zip(at, at[1:]))))
            return
        cased = fix.upper() if word.isupper() and len(word) > 1 else fix[:1].upper() + fix[1:] if word[:1].isupper() else fix
        # a line is misread where the change falls on its part of the word
        ends, at = [], 0
        for t, _, line, _, _ in atoms:
            at += len(t) + (len(how) if at else 0)
            ends.append((at, line))
        if fix != word.lower():
            pairs = [(0, len(word))] if len(atoms) == 1 else [(a, b) for tag, a, b, _, _ in difflib.SequenceMatcher(None, word.lower(), fix, autojunk=False).get_opcodes() if tag != "equal"]
            for a, b in pairs:
                low = 0
                for end, line in ends:
                    if a < end and (b > low or a == b and a >= low):
                        self._tag(line, "misread")
                    low = end
        for k, (_, _, line, a, b) in enumerate(atoms):
            self.fixes.setdefault(line, []).append((a, b, cased if k == 0 else ""))
            if k and joints[k - 1] != " ":
                self.joined[atoms[k - 1][2]] = "\0"

    def repaired(self) -> str:
        """Continuous paragraphs, without headers and page numbers."""
        lines, whole = {}, False
        for i in self.body:
            raw = self.lines[i]
            m = _BREAK.search(raw) if i in self.joined else None
            s = skeleton(raw[: m.start()] if m else raw).rstrip()
            for a, b, fix in sorted(self.fixes.get(i, []), reverse=True):
                s = s[:a] + fix + s[b:]
            lines[i] = s.rstrip() if whole else s.strip()  # where a word went to the line before, what follows it keeps its space
            whole = self.joined.get(i) == "\0"
        return "\n\n".join(self._paragraphs(lines))

    def _paragraphs(self, lines: dict[int, str]) -> list[str]:
        """Boundaries between body lines by dynamic programming: a cost for each join, a cost for each paragraph."""
        body = [i for i in self.body if lines[i] or i in self.joined]
        if not body:
            return []
        width = sorted(len(self.lines[i].rstrip()) for i in body)[int(0.8 * (len(body) - 1))]

        def gap(a: int, b: int) -> float:
            """Bits by which a boundary between two lines is likelier than none."""
            if a in self.joined:
                return -30.0
            left, right = lines[a], lines[b]
            s = -1.5
            s += 5.0 if any(not self.lines[k].strip() for k in range(a + 1, b)) and not any(k in self.numbers or k in self.headers for k in range(a + 1, b)) else 0.0
            s += 2.0 if _END.search(left) else -4.0
            s += 3.0 if len(self.lines[a].rstrip()) < 0.75 * width and _END.search(left) else 0.0
            s += 9.0 if left.startswith("#") or right.startswith(("#", "- ")) or left.startswith("- ") and right[:1].isupper() else 0.0
            s += 8.0 if len(left) < 0.5 * width and not _END.search(left) and (right[:1].isupper() or right[:1].isdigit()) else 0.0
            return s - (3.0 if right[:1].islower() else 0.0)

        # two states after each line: the paragraph goes on, or it ends; boundaries cost one bit more in a row
        stay, end, links = 0.0, -math.inf, []
        for a, b in zip(body, body[1:]):
            g = gap(a, b)
            prev = (stay, end)
            links.append((prev[0] >= prev[1], prev[0] >= prev[1] - 1))
            stay, end = max(prev), g + max(prev[0], prev[1] - 1)
        breaks, ended = [], end > stay
        for from_stay, from_stay_end in reversed(links):
            breaks.append(ended)
            ended = not (from_stay_end if ended else from_stay)
        breaks.reverse()
        out, cur = [], [body[0]]
        for i, brk in zip(body[1:], breaks):
            if brk:
                out.append(cur)
                cur = []
            cur.append(i)
        out.append(cur)
        result = []
        for part in out:
            s = ""
            for i in part:
                glue = "" if not s or s.endswith("\0") else " "
                s = s.rstrip("\0") + glue + lines[i] + {"": "\0", "-": "-\0", "\0": "\0"}.get(self.joined.get(i, "x"), "")
            result.append(" ".join(s.replace("\0", "").split()))
        return [x for x in result if x]


_WORDS = StructType([StructField("words", ArrayType(StructType([StructField("w", StringType()), StructField("n", LongType())]))), StructField("joins", ArrayType(StringType()))])
_FOUND = StructType([StructField("text", StringType()), StructField("found", ArrayType(StructType([StructField("line_no", IntegerType()), StructField("kind", StringType())])))])


_WORDS_ARROW, _FOUND_ARROW, _LIST_ARROW = map(to_arrow_type, (_WORDS, _FOUND, ArrayType(StringType())))
#: Rows that are Python objects at a time; a batch of Arrow's holds up to 10,000.
ROWS = 128


def _parts(batches: Iterator) -> Iterator[list[list]]:
    """The columns of batches (an array each, or several in a tuple) as lists of at most ROWS values."""
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        for at in range(0, len(columns[0]), ROWS):
            yield [c.slice(at, ROWS).to_pylist() for c in columns]


@F.arrow_udf(_WORDS)
def _words(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for (part,) in _parts(texts):
        out = []
        for t in part:
            words, joins = words_of(t) if t else ({}, [])
            out.append({"words": [{"w": w, "n": n} for w, n in words.items()], "joins": joins})
        yield pa.array(out, _WORDS_ARROW)


def lexicon_of(words: DataFrame, share: float = SHARE) -> tuple[DataFrame, dict[str, int], dict[str, int], int, int]:
    """(all words with their counts; counts of the common ones; words per letter triple; number of words; letters of the
    longest that a misread word may be) of rows of words.

    Triples are of a-z and the word's ends, 28**3 at most. Both are aggregated partly before the shuffle.
    """
    counts = staged(words.select(F.explode("words").alias("x")).groupBy("x.w").agg(F.sum("x.n").alias("n")), "words")
    total, longest = (x or 0 for x in counts.agg(F.sum("n"), F.max(F.when(F.col("n") >= LEAST, F.length("w")))).first())
    common = {r.w: r.n for r in counts.filter(F.col("n") >= max(1.0, share * total)).toLocalIterator()}
    latin = counts.filter(F.col("w").rlike("^[a-z]{3,30}$")).select(F.concat(F.lit("^"), "w", F.lit("$")).alias("w"))
    tri = latin.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substring(F.col("w"), i, F.lit(3)))).alias("t")).groupBy("t").count()
    return counts, common, {r.t: r["count"] for r in tri.toLocalIterator()}, total, longest


def _looked_up(words: DataFrame, counts: DataFrame, model) -> DataFrame:
    """(row, rare): of each row's words that are not common, count, best reading and its count, by joins with all counts."""

    @F.arrow_udf(ArrayType(StringType()))
    def rare(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        common = model.value[0]
        for words, joins in _parts(batches):
            yield pa.array([list({w for w in [*ws, *js] if w not in common}) for ws, js in zip(words, joins)], _LIST_ARROW)

    @F.arrow_udf(ArrayType(StringType()))
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (ws,) in _parts(batches):
            yield pa.array([list(readings(w, model.value[3])) for w in ws], _LIST_ARROW)

    asked = staged(words.select("row", F.explode(rare("words.w", "joins")).alias("w")), "asked")
    distinct = asked.select("w").distinct()
    read_as = distinct.select("w", F.explode(read("w")).alias("y")).join(counts.select(F.col("w").alias("y"), F.col("n").alias("many")), "y")
    best = read_as.groupBy("w").agg(F.max(F.struct("many", "y")).alias("b"))
    facts = distinct.join(counts, "w", "left").join(best, "w", "left").select("w", F.coalesce("n", F.lit(0)).alias("n"), F.col("b.y").alias("best"), F.coalesce("b.many", F.lit(0)).alias("many"))
    return asked.join(facts, "w").groupBy("row").agg(F.collect_list(F.struct("w", "n", "best", "many")).alias("rare"))


def repaired(docs: DataFrame, share: float = SHARE, text: bool = True) -> DataFrame:
    """(file_id, repaired, found): each text in continuous paragraphs, and its noise as (line_no, kind); without ``text``, the noise alone.

    All of ``docs`` (file_id, text, title, url) is read, whatever its flag for scans says; texts without noise keep their
    words. Null and empty texts stay as they are; repeated rows each have theirs. Texts are read twice, for the counts and
    for the repair; between, each distinct rare word is read once, and only rare words and counts are shuffled beside them.
    """
    rows = staged(docs.select(F.monotonically_increasing_id().alias("row"), "file_id", "text", "title", "url", _words(F.col("text")).alias("x")).select("row", "file_id", "text", "title", "url", "x.*"), "pages")
    counts, *known = lexicon_of(rows, share)
    model = docs.sparkSession.sparkContext.broadcast(known)
    looked = _looked_up(rows.select("row", "words", "joins"), counts, model)

    @F.arrow_udf(_FOUND)
    def fix(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        lexicon = Lexicon(*model.value)
        for texts, titles, urls, rare in _parts(batches):
            out = []
            for t, title, url, known in zip(texts, titles, urls, rare):
                if not t:
                    out.append({"text": t, "found": []})
                    continue
                lexicon.rare = {x["w"]: (x["n"], x["best"], x["many"]) for x in known} if known is not None else {}
                p = Page(t, title, url, lexicon)
                out.append({"text": p.repaired() if text else None, "found": [{"line_no": i, "kind": k} for i, kinds in sorted(p.kinds.items()) for k in sorted(kinds)]})
            yield pa.array(out, _FOUND_ARROW)

    both = rows.select("row", "file_id", "text", "title", "url").join(looked, "row", "left")
    if not text:
        return both.select("file_id", fix("text", "title", "url", "rare").alias("r")).select("file_id", F.col("r.found").alias("found"))
    return both.select("file_id", fix("text", "title", "url", "rare").alias("r")).select("file_id", F.col("r.text").alias("repaired"), F.col("r.found").alias("found"))


def noise(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """(file_id, line_no, kind) of every noisy line."""
    return repaired(docs, share, False).select("file_id", F.explode("found").alias("f")).select("file_id", "f.line_no", "f.kind")
