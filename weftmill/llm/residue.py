"""Template residue: unfilled placeholders, filler, error messages and notices that scripts are needed.

One automaton holds all patterns: phrases of errors, of filler and of script notices in several languages, the usual Latin
filler words, and the signs a placeholder begins with or is. One pass over a text finds them; what they cover is counted for
each sentence and for the whole document. A document is residue if a large share of it is covered, and also if a sentence
of it is, since an error notice or an unfilled line may stand in a long page.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType, ArrayType, StringType

from weftmill.llm.skeleton import skeleton

# Phrases by kind, in several languages, lower case, as they stand without accents' composition mattering.
PHRASES = {
    "script": """
        enable javascript | javascript is disabled | javascript is required | requires javascript | turn on javascript | javascript is not enabled
        please enable javascript to view this page | without javascript | activate javascript | turn on scripts in your browser | scripts switched on
        works only with scripts | allow scripts and reload | if nothing appears | noscript | does not support frames | does not support iframes
        it seems to be disabled | this content requires | to run this app | you need to turn on scripts
        activer javascript | javascript est desactive | javascript est désactivé | active javascript | activar javascript | habilite javascript | habilita javascript
        ative o javascript | ativar o javascript | aktivieren sie javascript | javascript aktivieren | javascript ist deaktiviert | pour afficher ce contenu | en su navegador para continuar | um fortzufahren
        कृपया अपने ब्राउज़र में जावास्क्रिप्ट चालू करें | जावास्क्रिप्ट सक्षम करें | जावास्क्रिप्ट चालू करें | यह सामग्री देखने के लिए जावास्क्रिप्ट
        कृपया जावास्क्रिप्ट सुरू करा | कृपया आपल्या ब्राउझरमध्ये जावास्क्रिप्ट सुरू करा | जावास्क्रिप्ट सक्षम करा
        કૃપા કરીને તમારા બ્રાઉઝરમાં જાવાસ્ક્રિપ્ટ ચાલુ કરો | કૃપા કરીને જાવાસ્ક્રિપ્ટ ચાલુ કરો | જાવાસ્ક્રિપ્ટ સક્ષમ કરો
    """,
    "error": """
        page not found | not found | was not found on this server | the requested address | the requested url | page can't be found | page cannot be found | page could not be found
        the page you requested | has moved or never existed | page does not exist | no longer available | nothing matched your search | try again with other words | no results found
        access denied | access forbidden | permission denied | you don't have permission to | you do not have permission to | to view this resource | to access this resource | unauthorized
        internal server error | bad gateway | gateway time-out | gateway timeout | service unavailable | service temporarily unavailable | bad request | too many requests | request timed out
        error establishing a database connection | fatal error | uncaught exception | parse error | undefined variable | in page on line | undefined index | stack trace | traceback (most recent call last) | null pointer
        scheduled maintenance | down for maintenance | under maintenance | we will be back shortly | be right back | temporarily offline | under construction
        checking your browser | verify you are human | completing the check below | are you a robot | complete the captcha | before you proceed | from your network
        session has expired | session expired | sign in again | please log in again | try again later | try later | please contact the administrator
        connection was reset | while loading the document | connection timed out | connection refused | bandwidth limit exceeded | an error occurred | something went wrong | an error has occurred
        go back to the home page | report this problem | return to the homepage | reference no
        page introuvable | page non trouvée | vérifiez l'adresse | accès refusé | accès interdit | erreur interne | une erreur est survenue | service indisponible
        página no encontrada | compruebe la dirección | acceso denegado | error interno | se ha producido un error | servicio no disponible
        página não encontrada | verifique o endereço | acesso negado | erro interno | ocorreu um erro | serviço indisponível
        seite nicht gefunden | prüfen sie die adresse | zugriff verweigert | interner serverfehler | ein fehler ist aufgetreten | dienst nicht verfügbar | wartungsarbeiten
        पृष्ठ नहीं मिला | कृपया पता जाँचें | ફરી પ્રયત્ન કરો | पेज नहीं मिला | पहुँच अस्वीकृत | पान सापडले नाही | પૃષ્ઠ મળ્યું નથી | પાનું મળ્યું નથી
    """,
    "filler": """
        your text goes here | text goes here | title goes here | subtitle goes here | content goes here | click edit to change this | click here to edit | click to edit
        this is a sample heading | sample heading | sample text | sample page | replace it with your own words | replace this text | write something about yourself | text block
        add a short description of | in this box | this is your first post | edit or delete it | just another site | placeholder text | dummy text
        asdf | qwer | qwerty | blah blah | test test | foo bar | lorem ipsum | dolor sit amet
        texte d'exemple | à remplacer avant la mise en ligne | texte de remplissage | votre texte ici | texto de ejemplo | cambie este párrafo | su texto aquí | texto de relleno
        texto de exemplo | altere este parágrafo | seu texto aqui | ihr text | blindtext | dies ist ein blindtext | hier steht später | platzhalter | beispieltext
        यहाँ अपना पाठ लिखें | यह नमूना पाठ है | यह केवल नमूना है | तुमचा मजकूर येथे | તમારું લખાણ અહીં
    """,
    "common": "forbidden | warning | on line | slow down | please wait | loading | oops | hello world | welcome | button | coming soon",
}
# What a placeholder begins with, and words that stand where a value is missing.
OPENINGS = "« | &lt; | {{ | {% | ${ | { | <% | <? | << | < | @@ | __ | % | # | [[ | [ | undefined | null | nan | xx"
# The words of the usual Latin filler text.
LATIN_FILLER = """
    lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad
    minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit
    voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia
    deserunt mollit anim id est laborum vivamus praesent vestibulum pellentesque curabitur mauris
"""  # fmt: skip
# Words of sentences that write about placeholders, scripts or errors rather than show them.
ABOUT = """
    means meaning word words term called named replaced stands shows shown explains explain learn lesson example syntax template templates variable variables chapter syllabus programming scripts
    syntaxe exemple signifie significa ejemplo plantilla exemplo palavra bedeutet beispiel vorlage wort
"""  # fmt: skip

_NAME = r"[A-Za-z][\w.\- ]{0,40}"
#: Marked places, tried where the automaton has found an opening. In single brackets a capitalised word may be a remark.
_MARKED = regex.compile(
    rf"«\s*{_NAME}\s*»|&lt;\s*{_NAME}\s*&gt;|\{{\{{\s*{_NAME}\s*\}}\}}|\{{%-?\s*{_NAME}\s*-?%\}}|\$\{{\s*{_NAME}\s*\}}|<[?%]=?\s*\$?{_NAME}\s*;?\s*[?%]>|<<\s*{_NAME}\s*>>|@@{_NAME}@@|__[A-Z][A-Z0-9_.]*[A-Z0-9]__"
    r"|(?<!\w)%[A-Z][A-Z_.]{2,30}%(?!\w)|\{[a-z]+(?:[_.][a-z]+)*\}|\{\d{1,2}\}|#[A-Z][A-Z_. ]{2,30}#|\[\[\s*[A-Za-z][\w. ]{0,40}\s*\]\]"
    r"|\[(?:insert|enter|your|add|type)\b[^\]\n]{1,40}\]|\[object Object\]|<[a-z]+(?:[_.][a-z]+)+>|<(?:name|course|venue|principal|department|link|date|title|phone|year|email|address|amount|student|teacher|subject|city)>"
)
_BRACKETED, _BARE = regex.compile(r"\[[A-Z][a-z]+(?:[ .][A-Z][a-z]+){0,3}\]"), regex.compile(r"(?<![\w$.])(?:undefined|NaN|null|X{2,8})(?!\w)")
#: Before and after the place of a value. A name before XX makes it a number.
_BEFORE = regex.compile(r"(?:^|[:(,]|\b(?:[a-z]+|Dear|To|From|By|For|At|In|On))\s*$")
_NO_VALUE = regex.compile(r"\b(?:the|an?|no|not|is|are|was|were|be|been|as|or|of|returns?|returned|equals?|becomes?|called|says?|word|type|value)\s*$")
_AFTER = regex.compile(r"^\s*(?:$|[.,;:!?)\]।]|(?:for|from|before|by|in|on|at|to|of|and|must|has|have|will|invites?|closes?|opens?|is|was|are)\b)")
_SENTENCE = regex.compile(r"[^.!?।…\n]*(?:[.!?।…](?![\"”’)\]]*\s)[^.!?।…\n]*)*[.!?।…]*[\"”’)\]]*")
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}]+)?")
#: A sentence is residue if at least this share of its letters is matched by phrases that say it themselves; a document, if
#: at least this share is matched by phrases of any kind, common words included.
COVERAGE, DOCUMENT_COVERAGE = 0.55, 0.5


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word in LATIN_FILLER.split():
        if len(word) > 4:
            a.add_word(word, ("latin", len(word)))
    for kind, block in (PHRASES | {"open": OPENINGS}).items():
        for line in block.strip().split("\n"):
            for p in line.split("|"):
                p = skeleton(p.strip()).lower()
                if p:
                    a.add_word(p, (kind, len(p)))
    a.make_automaton()
    return a


def _lower(s: str) -> str:
    """Lower case, character by character, so that places stay the same."""
    low = s.lower()
    return low if len(low) == len(s) else "".join(c.lower() if len(c.lower()) == 1 else c for c in s)


def _letters(s: str) -> int:
    return sum(map(str.isalnum, s)) - sum(map(str.isdigit, s))


class Matcher:
    """Finds the residue of a text in one pass of the automaton."""

    def __init__(self):
        self.automaton = _automaton()
        self.latin, self.about = set(LATIN_FILLER.split()), set(ABOUT.split())

    def hits(self, low: str) -> dict[str, list[tuple[int, int]]]:
        """Places of phrases by kind, those that begin and end at word bounds."""
        out: dict[str, list[tuple[int, int]]] = {}
        for end, (kind, n) in self.automaton.iter(low):
            a, b = end - n + 1, end + 1
            if kind == "open" or (a == 0 or not (low[a - 1].isalnum() and low[a].isalnum())) and (b == len(low) or not (low[b].isalnum() and low[b - 1].isalnum())):
                out.setdefault(kind, []).append((a, b))
        return out

    def residue(self, text: str) -> list[tuple[str, str, float]]:
        """(kind, sentence, share) of every sentence or line that is residue."""
        flat = skeleton(text)
        low = _lower(flat)
        hits = self.hits(low)
        if not hits:
            return []
        bounds = [(m.start(), m.end()) for m in _SENTENCE.finditer(flat) if m.group().strip()]
        starts = [a for a, _ in bounds]
        by: dict[int, dict[str, list[tuple[int, int]]]] = {}
        for kind, spans in hits.items():
            for span in spans:
                k = bisect.bisect_right(starts, span[0]) - 1
                if k >= 0:
                    by.setdefault(k, {}).setdefault(kind, []).append(span)
        strong, weak, covered = [], [], 0
        for k, found in sorted(by.items()):
            a, b = bounds[k]
            got = self._sentence(flat[a:b], low[a:b], {kind: [(x - a, y - a) for x, y in spans] for kind, spans in found.items()})
            if got:
                kind, share, n, sure = got
                covered += n
                (strong if sure else weak).append((a, kind, flat[a:b].strip(), share))
        if weak and covered >= DOCUMENT_COVERAGE * max(1, _letters(flat)):
            strong = sorted(strong + weak)
        return [x[1:] for x in strong]

    def _sentence(self, s: str, low: str, found: dict[str, list[tuple[int, int]]]) -> tuple[str, float, int, bool] | None:
        """(kind, share of its letters matched, letters matched, whether it is residue by itself) of a sentence with hits."""
        letters = max(1, _letters(s))
        if "open" in found and (marks := _places(s, [a for a, _ in found["open"]])):
            rest = list(s)
            for a, b in marks:
                rest[a:b] = " " * (b - a)
            if not _mentions(self.about, "".join(rest)):
                share = min(1.0, sum(b - a for a, b in marks) / len(s))
                return "placeholder", share, letters, True
        if "latin" in found:
            words = _WORD.findall(low)
            latin = [w for w in words if w in self.latin]
            if len(words) >= 4 and len(latin) >= 0.7 * len(words) and len({w for w in latin if len(w) > 2}) >= 3:
                return "filler", len(latin) / len(words), sum(map(len, latin)), True
        spans = sorted((a, b, kind) for kind, xs in found.items() if kind not in ("open", "latin") for a, b in xs)
        total = own = reach = 0
        size: dict[str, int] = {}
        for a, b, kind in spans:
            if b > reach:
                n = sum(map(str.isalnum, s[max(a, reach) : b]))
                total, own, reach = total + n, own + n * (kind != "common"), b
                size[kind] = size.get(kind, 0) + n
        if not total:
            return None
        kind = max(size, key=lambda k: (k != "common", size[k]))
        share = min(1.0, total / letters)
        sure = share >= COVERAGE and 2 * own >= total
        return ("error" if kind == "common" else kind, share, total, sure) if sure or share >= COVERAGE else None


def _places(s: str, at: list[int]) -> list[tuple[int, int]]:
    """Where a value is missing in a sentence: marked places, and bare words in the place of a value."""
    out: list[tuple[int, int]] = []
    doubtful: list[tuple[int, int]] = []
    for a in sorted(set(at)):
        if out and a < out[-1][1]:
            continue
        if m := _MARKED.match(s, a):
            out.append(m.span())
        elif m := _BRACKETED.match(s, a):
            alone = not s[: m.start()].strip(" -*#")
            after = s[m.end() :].lstrip()
            if " " in m.group() or "." in m.group() or not alone or after[:1].islower():
                out.append(m.span())
            else:
                doubtful.append(m.span())
        elif (m := _BARE.match(s, a)) and (not doubtful or a >= doubtful[-1][1]):
            sure = _BEFORE.search(s[: m.start()]) and not _NO_VALUE.search(s[: m.start()]) and _AFTER.search(s[m.end() :])
            (out if sure else doubtful).append(m.span())
    return sorted(out + doubtful) if out or len({s[a:b] for a, b in doubtful}) < len(doubtful) and doubtful else []


def _mentions(about: set[str], rest: str) -> bool:
    """Whether a sentence without its placeholders has one of the words, in lower case: names of subjects don't count."""
    return any(w in about for w in _WORD.findall(rest))


_HIT = StructType([StructField("kind", StringType()), StructField("sentence", StringType()), StructField("share", DoubleType())])


@F.pandas_udf(ArrayType(_HIT))
def residue_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    m = Matcher()
    for s in texts:
        yield s.map(lambda t: [dict(zip(("kind", "sentence", "share"), x)) for x in m.residue(t)] if t else [])


def residue(text: Column) -> Column:
    """Residue sentences of ``text`` as (kind, sentence, share); empty for null, empty and blank texts and for texts without any.

    A sentence that writes about errors, scripts or placeholders is none, since the phrases cover little of it. Common
    words such as "Welcome" or "Loading" make one only where most of the document is covered.
    """
    return residue_udf(text)


def without_residue(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` without those that hold residue; null, empty and blank texts hold none."""
    return documents.filter(F.size(residue(F.col(text))) == 0)
