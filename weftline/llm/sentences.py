"""Sentence units of texts in several languages and scripts.

Ordered rule tables decide every position that could end a unit.  A rule has a
pair of regular expressions, one for what lies before the position and one for
what follows, and says break or no break; the first rule that matches decides.
A rule may also ask for the place of the position: inside a quotation or
brackets, or behind a quotation that begins the unit.  Tables cascade: what
holds everywhere, then the language's own, then defaults.

Each block between blank lines is read in one sweep and each position is tried
once against the whole block, so the time grows with the text's length only.

Languages are told apart by script, and within the Latin script by the most
frequent words.  A block with enough of them is judged by itself, others by the
whole text; the recorded language only settles ties, for records may be
labelled wrongly.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.shape import spread

# Characters.
ENDS = ".?!。？！．｡。…।॥؟‼⁇⁈⁉"
QUOTES = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‹": "›"}
BRACKETS = {"(": ")", "（": "）", "[": "]", "【": "】"}
CLOSERS = "”»“」』›)）]】\"'’"
SURE_CLOSERS = "”»」』›)）]】’"  # the others of CLOSERS also open
GREEK_QUESTION = ";;"

# Abbreviations after which a sentence goes on.
INNER = {
    "en": "mr mrs ms dr prof st approx vs e.g i.e no nos vol ch p pp fig sec cf jr sr gen rev al",
    "de": "hr fr dr prof nr vgl ca bzw abs art d.h z.b d z s st bd hrsg str",
    "fr": "mme mmes mlle m mm pr dr art chap vol cf p pp ex n no fig",
    "es": "dr dra sr sra srta prof aprox cap vol pág págs p ej i e núm art fig",
    "ru": "акад проф д-р руб коп тыс прим напр п гл разд см стр рис т г ул др тов",
    "el": "κ κα κος περ αρ τόμ κεφ π.χ δηλ βλ σελ δρ καθ",
    "hi": "श्री डॉ प्रो क्र सं पृ सु श्रीमती",
    "ar": "د أ أ.د ص م.م ج",
    "th": "ดร ศ รศ ผศ นพ พญ น พ.ศ ค.ศ",
    "zh": "no vol p dr mr",
    "ja": "no vol p dr mr",
}
# Abbreviations that often stand last in a sentence.
FINAL = {
    "en": "etc p.m a.m co inc ltd",
    "de": "usw etc co vorm nachm",
    "fr": "etc env cie",
    "es": "etc p. m a. m p.m a.m cía",
    "ru": "т. д т.д т. п т.п ч ко",
    "el": "κ.λπ μ.μ π.μ σία",
    "ar": "م",
}
# Months and nouns after German ordinals.
ORDINAL_NEXT = "januar februar märz april mai juni juli august september oktober november dezember jahr jahrhundert"
# The most frequent words of languages of the Latin script.
WORDS = {
    "en": "the be to of and a in that have it for not on with he as you do at this but his by from they we say her she or an will my one all would there their what so up out if about who which go me",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ou mais comme nous sa été cette elle ses à y leur on deux tout lui fait même",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta",
}
#: Frequent words from which on a block tells its own language.
TELLING = 12


def _alternatives(words: str, multi: bool = False) -> str:
    """A pattern of listed abbreviations, the longest first."""
    listed = re.split(r" (?!m\b|д\b|п\b)", words) if multi else words.split()
    return "|".join(re.escape(w).replace(r"\ ", r"\s?") for w in sorted(listed, key=len, reverse=True))


CASELESS = {"zh", "ja", "th", "hi", "ar"}

LETTER = r"[^\W\d_]"


#: Places of a position that a rule may ask for.
ANYWHERE, INSIDE, OPENING = "", "inside", "opening"


def table(language: str) -> list[tuple]:
    """The cascaded rules of a language: (breaks, before, after) and the place, if not ANYWHERE.

    ``before`` must match up to the position, which lies behind the sentence's
    end marks and closers (in Thai also before a space); ``after`` from it on,
    white space included.
    """
    any_ = ""
    low = r"\s*[a-zà-öø-ÿα-ωά-ώа-яё]"
    rows: list[tuple] = [
        (False, any_, any_, INSIDE),  # a quotation or brackets stay whole
    ]
    if language == "th":  # sentences end with a space, which also stands around numbers, quotations and some words
        rows.append((True, r"[ก-ฺ฿-ๅ็-๏๚๛)]", r"\s+[^\s\dๆ(]"))
    if language in CASELESS:
        rows.append((False, any_, r"\s*\S", OPENING))  # a quotation begins the unit: its clause follows
    rows += [
        (False, r"\d[.．]", r"\d"),  # decimals, times, versions
        (False, r"\s(?:\.{2,}|…+)", any_),  # a pause: the ellipsis stands apart
        (False, r"……", any_),  # a pause in Chinese and Japanese
        (False, any_, r"\s*[,;:،؛，、；：·–—-]"),  # the clause goes on
        (False, any_, r"[.?!…。？！．｡।]"),  # inside a run of end marks
    ]
    if language in ("zh", "ja"):
        rows.append((False, r"[.]", r"\s*[\w]"))  # a numbered entry, a point inside a word
    else:
        rows += [(True, r"[^\W\d_]{3,}[.]", r"[A-ZÀ-ÖØ-ÞΑ-ΩА-Я][^\W\d_]"), (False, r"[.]", r"\S")]  # a lost space; a point inside a word
    if language in FINAL:
        final = rf"(?:^|[^\w.])(?:{_alternatives(FINAL[language], True)})\."
        rows += [(False, r"\benv\.", r"\s*\d"), (True, final, r"\s+[^a-zα-ωа-я]"), (True, final, r"\s*$")]
    if language == "de":
        rows.append((False, r"\d\.", rf"\s+(?i:{_alternatives(ORDINAL_NEXT)})\b"))
    rows += [
        (False, rf"(?:^|[^\w.])(?i:{_alternatives(INNER.get(language, INNER['en']))})\.", r"\s"),
        (False, rf"(?:^|[^\w]){LETTER}\.", r"\s"),  # an initial
        (False, rf"(?:^|[^\w]){LETTER}\.{LETTER}\.", r"\s*[^\W_]"),
    ]
    if language == "ja":
        rows += [(False, r"[」』]", r"\s*[とはがのをにもで]"), (False, r"[）)]", r"\s*[とはがのをにも]")]
    rows += [
        (False, r"[.?!…]\s?[”»“’\"]+", low),  # the clause of a quotation
        (True, rf"[{ENDS}{'|' if language == 'hi' else ''}][{re.escape(CLOSERS)}\s]*", any_),
        (True, rf"[{GREEK_QUESTION}][{re.escape(CLOSERS)}]*" if language == "el" else r"(?!)", any_),
    ]
    return rows


def lowered(language: str) -> list[tuple]:
    """The rules for a block without capitals, where case tells nothing."""
    rows = table(language)
    if language in FINAL and language not in CASELESS:
        rows[1:1] = [(False, r"\benv\.", r"\s*\d"), (True, rf"(?:^|[^\w.])(?:{_alternatives(FINAL[language], True)})\.", r"\s")]
    return rows


@cache
def compiled(language: str, cased: bool) -> dict[str, regex.Pattern]:
    """The table as one pattern for each place: alternatives in their order, each a look back and a look ahead, named by their number and b where they break."""
    rows = table(language) if cased else lowered(language)
    out = {}
    for place in (ANYWHERE, INSIDE, OPENING):
        own = [(k, breaks, before, after) for k, (breaks, before, after, *where) in enumerate(rows) if not where or where[0] == place]
        out[place] = regex.compile("|".join(rf"{f'(?<={before})' if before else ''}{f'(?={after})' if after else ''}(?P<{'b' if breaks else 'n'}{k}>)" for k, breaks, before, after in own))
    return out


# Letters of the scripts.
SCRIPTS = {"th": "ก-๛", "hi": "ऀ-ॿ", "ar": "؀-ۿ", "ru": "Ѐ-ӿ", "el": "Ͱ-Ͽ", "ja": "぀-ヿ", "zh": "一-鿿", "latin": "A-Za-zÀ-ɏ"}
_SCRIPT = {k: re.compile(f"[{v}]") for k, v in SCRIPTS.items()}
_FREQUENT = {k: re.compile(rf"\b(?:{'|'.join(sorted(v.split(), key=len, reverse=True))})\b") for k, v in WORDS.items()}


def script_of(text: str) -> str:
    """The language that a script stands for, or 'latin'."""
    if text.isascii():
        return "latin"
    counts = {k: len(p.findall(text)) for k, p in _SCRIPT.items()}
    counts["ja"] *= 2
    if counts["ja"] and counts["ja"] * 5 > counts["zh"]:
        counts["zh"] = 0
    return max(counts, key=lambda k: counts[k])


def frequent(text: str) -> Counter:
    """How many of each Latin-script language's frequent words a text has."""
    lower = text.lower()
    return Counter({k: len(p.findall(lower)) for k, p in _FREQUENT.items()})


def _best(score: Counter, code: str) -> str:
    return max(WORDS, key=lambda k: (score[k], k == code, k == "en"))


def languages_of(blocks: list[str], recorded: str | None) -> list[str]:
    """The language whose rules each block of a text gets, from all letters and words of the text."""
    code = (recorded or "").lower()[:2]
    scripts = [script_of(b) for b in blocks]
    scores = [frequent(b) if s == "latin" else Counter() for b, s in zip(blocks, scripts, strict=True)]
    whole = _best(sum(scores, Counter()), code)
    return [s if s != "latin" else _best(score, whole) if score.total() >= TELLING else whole for s, score in zip(scripts, scores, strict=True)]


_BLANK = re.compile("(?:\r\n|\r|\n)[^\\S\r\n]*(?:(?:\r\n|\r|\n)[^\\S\r\n]*)+|\u2029")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_SPACES = re.compile(r"\s*")
_THAI_SPACES = re.compile(r"(?<=\S)\s+")
_MARKS = re.compile(f"[{re.escape(''.join(QUOTES))}\"{re.escape(''.join(BRACKETS))}]")
#: End marks behind a quotation mark without its counterpart, up to which the quotation counts as cut off; beyond, the mark is a stray one.
CUT_OFF = 4


def _places(block: str, characters: str) -> list[int]:
    return [m.start() for m in re.finditer(f"[{re.escape(characters)}]", block)]


def _spans(block: str, ends: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Quotations and brackets as (start, end) of their marks; a cut-off quotation reaches to the end."""
    quoted, bracketed = [], []
    n, i = len(block), 0
    known: dict[str, list[int]] = {}

    def after(characters: str, at: int) -> int:
        """The first of the characters behind a place, -1 if there is none."""
        if characters not in known:
            known[characters] = _places(block, characters)
        k = bisect_left(known[characters], at + 1)
        return known[characters][k] if k < len(known[characters]) else -1

    while m := _MARKS.search(block, i):
        i = m.start()
        c = block[i]
        if c in QUOTES or c == '"':
            j = after(QUOTES.get(c, '"'), i)
            if j >= 0:
                quoted.append((i, j + 1))
                i = j + 1
                continue
            if len(ends) - bisect_left(ends, i) <= CUT_OFF:
                quoted.append((i, n))
                break
        else:
            j = after(BRACKETS[c], i)
            if j >= 0:
                bracketed.append((i, j + 1))
                if not 0 <= after("“„«「『\"", i) < j:
                    i = j + 1
                    continue
        i += 1
    return quoted, bracketed


@cache
def _candidates(language: str) -> re.Pattern:
    marks = ENDS + {"el": GREEK_QUESTION, "hi": "|"}.get(language, "")
    return re.compile(rf"[{re.escape(marks)}]+")


def _behind_closers(block: str, at: int, closing: set[int]) -> int:
    """The place behind the marks that close what ends here; ``closing`` are those of known pairs."""
    while at < len(block):
        if at in closing or block[at] in SURE_CLOSERS:
            at += 1
        elif block[at].isspace() and block[at + 1 : at + 2] == "»":
            at += 2
        else:
            break
    return at


def split_block(block: str, language: str) -> list[tuple[int, int]]:
    """Units of a block without blank lines, as offsets into it."""
    shown = None
    if _INVISIBLE.search(block):  # rules see the text without them
        shown = [i for i, c in enumerate(block) if not _INVISIBLE.match(c)]
        block, whole = _INVISIBLE.sub("", block), block
    marks = [m.end() for m in _candidates(language).finditer(block)]
    quoted, bracketed = _spans(block, marks)
    rules = compiled(language, language in CASELESS or any(c.isupper() for c in block))
    closing = {e - 1 for _, e in quoted + bracketed}
    places = {_behind_closers(block, at, closing) for at in marks}
    if language == "th":
        places.update(m.start() for m in _THAI_SPACES.finditer(block))
    spans = sorted(quoted + bracketed)
    opener = {e: s for s, e in quoted}
    ends: list[int] = []
    begin = _SPACES.match(block).end()
    k = reach = 0
    for at in sorted(places):
        while k < len(spans) and spans[k][0] < at:
            reach = max(reach, spans[k][1])
            k += 1
        place = INSIDE if at < reach else OPENING if opener.get(at) == begin else ANYWHERE
        m = rules[place].match(block, at)
        if m and m.lastgroup[0] == "b":
            ends.append(at)
            begin = _SPACES.match(block, at).end()
    units, start = [], 0
    for end in [*ends, len(block)]:
        piece = block[start:end]
        if own := piece.strip():
            lead = start + len(piece) - len(piece.lstrip())
            units.append((lead, lead + len(own)))
        start = end
    if shown is not None:  # back to places in the text as it is; what is invisible belongs to the unit before it
        units = [(shown[s], shown[e] if e < len(shown) else len(whole)) for s, e in units]
        units = [(s, s + len(whole[s:e].rstrip())) for s, e in units]
    return units


def split(text: str | None, recorded: str | None = None) -> list[tuple[int, int]]:
    """Units of a text, as (start, end) in code points."""
    if not text or not text.strip():
        return []
    blocks, start = [], 0
    for a, b in [*[m.span() for m in _BLANK.finditer(text)], (len(text), len(text))]:
        if text[start:a].strip():
            blocks.append((start, text[start:a]))
        start = b
    languages = languages_of([b for _, b in blocks], recorded)
    return [(start + s, start + e) for (start, block), language in zip(blocks, languages, strict=True) for s, e in split_block(block, language)]


_OUT = pa.schema([("id", pa.int64()), ("unit_no", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("unit", pa.string())])


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, nos, starts, ends, units = [], [], [], [], []
        for k, text, recorded in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for no, (s, e) in enumerate(split(text, recorded)):
                ids.append(k)
                nos.append(no)
                starts.append(s)
                ends.append(e)
                units.append(text[s:e])
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip((ids, nos, starts, ends, units), _OUT, strict=True)], schema=_OUT)


def sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """(doc_id, unit_no, start_char, end_char, unit): sentence units of each text.

    Positions count code points from 0, the end is exclusive, and units have no
    white space around them.  A blank line ends a unit, a single line break
    does not.  A quotation stays in one unit with its clause; one that is cut off
    reaches to the end of its block, and a mark without its counterpart that more
    than CUT_OFF end marks follow counts for nothing.  NULL, empty and white texts have
    no units; whole texts are read, however long.  Repeated rows give repeated
    units; a NULL id is kept.  Each row is independent: nothing is shuffled, unless
    a table has fewer partitions than there are cores.
    """
    recorded = F.lit(None).cast("string") if lang is None else F.col(lang).cast("string")
    got = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"), recorded.alias("lang")).where(F.col("text").isNotNull())
    return spread(got).mapInArrow(_map, "id bigint, unit_no bigint, start_char bigint, end_char bigint, unit string").withColumnRenamed("id", doc_id)
