"""Problem 5: personal information in free text, found and replaced by typed placeholders.

Weak supervision: labelers (patterns, gazetteers, context, shape) vote on candidate spans. The spans of each type are
counted by their vector of votes, and expectation-maximisation over those counts estimates the reliability of every labeler
and the probability of every vector; there are at most 3 ** LABELERS vectors a type, so the driver does it whatever the
size of the input. A logistic classifier of spans then learns those probabilities from the votes, the words around a span
and its shape, on a sample of about ``SAMPLE`` spans a type drawn by a hash; it decides on every span.

The given gazetteer of name parts is incomplete; it is extended from the corpus by words that stand where a surname
follows a known given name, or a given name comes before a known surname.

Positions are those of the stored text: it is read through a map of its characters that undoes the looks of problem 1.
All that is found in a text stays in one row until its spans have been decided, so no text is shuffled.

Defined results: null and empty texts give no rows and stay as they are; repeated rows are found each; overlapping spans
go to the longer, then to the type first in ``TYPES``; an empty gazetteer leaves titles and contexts to vote.
"""

from __future__ import annotations

import math
import re
import unicodedata as ud
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.lookalike import fixed_forms, is_invisible
from palimpsest.llm.scannoise import skeletons
from palimpsest.plans.runtime import materialise, small_rows

TYPES = ("email", "address", "phone", "id_number", "person_name")
LABELERS = 5
ABSTAIN = -1
#: Characters before a span that the labelers of its context see: more than the longest of their phrases.
CONTEXT = 26
#: An unlisted name part stands by listed ones in this share of its places, ``DOUBT`` imagined places where it doesn't added.
MEETING_SHARE, DOUBT = 0.22, 9
#: Roles of words are sent to all tasks up to this many; more are joined.
BOUND = 500_000
#: Spans of each type the classifier is trained on, and the size of the table its features are hashed to.
SAMPLE, TABLE = 5_000, 1 << 14
#: Features of a span beside its votes.
FEATURES = 8

UP, LOW = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĻŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽ", "a-zß-öø-ÿāăąćčďđēėęěğģīįıķĺļłńņňōőœŕřśşšţťūůűųźżž"


@lru_cache(1)
def _tables() -> tuple[dict[int, str], re.Pattern, re.Pattern]:
    """One-for-one replacements of look-alike characters, a pattern of those, and one of what takes another number of characters."""
    forms = fixed_forms()
    one = {ord(c): to for c, to in forms.items() if len(to) == 1}
    moved = [c for c, to in forms.items() if len(to) != 1] + [c for c in map(chr, [*range(0x80, 0x3200), *range(0xFE20, 0xFE30)]) if ud.combining(c) and c not in forms]
    return one, *(re.compile("[" + "".join(map(re.escape, cs)) + "]") for cs in (map(chr, one), moved))


class Places:
    """Where the characters of a plain text stand in the stored one: the beginnings of stretches, and how far each is moved."""

    __slots__ = ("begins", "shifts")

    def __init__(self) -> None:
        self.begins, self.shifts = [0], [0]

    def __getitem__(self, i: int) -> int:
        return i + self.shifts[bisect_right(self.begins, i) - 1]

    def move(self, i: int, shift: int) -> None:
        if self.begins[-1] == i:
            self.shifts[-1] = shift
        else:
            self.begins.append(i)
            self.shifts.append(shift)


def plain(text: str) -> tuple[str, Places | None]:
    """The text without the looks of problem 1, and where its characters stand in the stored one (None: at the same place)."""
    if text.isascii():
        return text, None
    one, odd, moved = _tables()
    if odd.search(text):
        text = text.translate(one)
    m = moved.search(text)
    if not m:
        return text, None
    out: list[str] = []
    at, n, last = Places(), 0, 0
    while m:
        i = m.start()
        if i > last:
            out.append(text[last:i])
            n += i - last
        c, last = m[0], i + 1
        if is_invisible(c):
            pass
        elif ud.combining(c):
            if out and len(x := ud.normalize("NFC", out[-1][-1] + c)) == 1:
                out[-1] = out[-1][:-1] + x
        else:
            x = ud.normalize("NFKC", c)
            for k in range(len(x)):
                at.move(n + k, i - n - k)
            out.append(x)
            n += len(x)
        at.move(n, last - n)
        m = moved.search(text, last)
    return "".join([*out, text[last:]]), at


def _end(text: str, at: Places, end: int) -> int:
    """Stored end of a span: behind its last character and the marks on it."""
    e = at[end - 1] + 1
    while e < len(text) and ud.combining(text[e]):
        e += 1
    return e


# --- candidates -------------------------------------------------------------------------------------------------------

_EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]++\s{0,2}(?:@|\(at\)|\[at\]|\{at\})\s{0,2}[\w-]+(?:(?:\.|\s?[\[({]dot[\])}]\s?)[\w-]+)*", re.I)
_NUMBER = re.compile(r"(?<![\w.,/$£€+-])(?:[A-Z]{2}\s|[A-Z])?[+(]?\d(?:\d|[\s().\-/]{1,3}(?=\d|\(\d))*\d(?:\s[A-Z]\b)?(?![\w/])(?:,?\s+(?:ext|Ext|x|Durchwahl|poste)\.?\s*\d{1,5})?")
# Formats of telephone and identity numbers in the countries the texts come from (9: a figure).
PHONES = ("+99 (9)99 99999-999", "+99 99 9999 9999", "+9 999 999 9999", "9-999-999-9999", "(999) 999-9999", "999-999-9999", "999.999.9999", "999 9999 9999", "999 99999 999", "99 99 99 99 99", "99999-999", "999 99999-999", "+99 9 99 99 99 99", "9999 999999", "+99 99 99999999")
IDS = ("99 999 999 999", "999-99-9999", "999 99 9999", "X99999999", "9 99 99 999 999", "AA 99 99 99 A", "9 99 99 99 999 999 99")
# Words before a number that say what it is, and such that say it is something else.
PHONE_WORDS = r"(?:tel|tél|telefon|phone|fax|ring|call|number|mobile|rückfragen unter|under|joindre|notaire au|appel\w*|or|oder|ou|contact)\W*$"
ID_WORDS = r"(?:no|nr|n°|card|carte|dossier|akte|with|papers under|security|passport|steuernummer|ausweis\w*|number|file|signs with)\W*$"
OTHER_WORDS = r"(?:serial|invoice|docket|exhibit|pages?|vol|ch|lot|section|cost|case|order|item|account|schedule|§|anno)\W*(?:no\W*)?$"
_PHONE_WORDS, _ID_WORDS, _OTHER_WORDS = (re.compile(x, re.I) for x in (PHONE_WORDS, ID_WORDS, OTHER_WORDS))

_STREET = r"(?:(?:Street|Road|Lane|Row|Avenue|Court|Place|Square|Terrace|Way|Drive|Close|Hill|Crescent|Boulevard)\b|(?:St|Rd|Ln|Ave|Ct|Pl|Sq|Dr|Blvd)\b\.?)"
_W = rf"[{UP}][{UP}{LOW}'’]+(?:-(?:\s)?[{UP}{LOW}'’]+)*"
_TOWN = rf"{_W}(?:\s{_W})?"
_UNIT = r"(?:,\s+(?:Unit|Apt|Apartment|Suite|Flat|Floor|Room)\b\.?\s*\w{1,5})"
_ENGLISH = re.compile(rf"(?<![\w.,/$£€-])\d{{1,4}}\s?[A-Z]?\s(?:{_W}\s){{1,3}}?{_STREET}{_UNIT}?(?:,\s+{_TOWN}(?:,?\s\d{{5}}(?!\d))?)?")
_FRENCH = re.compile(rf"(?<![\w.,/$£€-])\d{{1,4}}(?:,?\s(?:bis|ter|quater))?,?\s(?:rue|place|avenue|quai|chemin|boulevard|allée|impasse|cours|route)(?:\s(?:de\sla|de\sl['’]|des|du|de|d['’]))?\s?{_W}(?:,\s+\d{{5}}\s+{_W}(?:-[{LOW}]+-{_W})?)?")
# What German streets begin with, end in and have as a word of their own.
_AT, _ENDINGS, _WAYS = (r"Am|An\sder|Im|Zum|Zur|Auf\sdem|Hinter\sdem", "straße|strasse|str.|weg|gasse|platz|allee|ufer|damm|ring|markt|graben|steig", "Straße|Strasse|Weg|Gasse|Platz|Allee|Ufer|Markt")
_GERMAN = re.compile(rf"(?:(?:{_AT})\s{_W}|(?:(?:Alte[rn]?|Neue[rn]?|Kleine[rn]?|Große[rn]?|Obere[rn]?|Untere[rn]?|Lange[rn]?)\s)?[{UP}][{LOW}]+(?:{_ENDINGS.replace('.', chr(92) + '.')})|[{UP}][{LOW}]+(?:er|e|en)?\s(?:{_WAYS}))\s\Z")
_GERMAN_NUMBER = re.compile(rf"\d{{1,4}}(?:\s?[a-z]\b)?(?:,\s+\d{{5}}\s+{_TOWN})?")
# what a German street ends in, the one with a word of its own before it apart
_GERMAN_ENDS = tuple(dict.fromkeys([*_ENDINGS.split("|"), *_WAYS.split("|")]))
_AT_STARTS = tuple(x.split(r"\s")[0] for x in _AT.split("|"))
_NO_STREET = re.compile(rf"[^{UP}{LOW}'’.\s-]")
_FIGURES = re.compile(r"\d+")
_BEHIND_HOUSE = ", \t\n\r"


_TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Capt|Captain|Col|Rev|Herrn?|Frau|Hr|Fr|M|Mme|Mlle|Sr|Sra|Don|Doña|Madame|Monsieur|Sir|Lady)\b\.?"
_TOKEN = rf"(?:[{UP}]\.(?![{LOW}])|[{UP}][{UP}{LOW}]*(?:['’][{UP}][{UP}{LOW}]+)?(?:-\s?[{UP}][{UP}{LOW}'’]+)*)"
_RUN = re.compile(rf"(?<![\w@.'’-])(?:(?>{_TOKEN})(?:(?:,\s|\s{{1,3}}|\s?\n)(?>{_TOKEN}))+|[{UP}][{UP}{LOW}]*(?:-\s[{UP}][{UP}{LOW}'’]+)+)")
_TITLED = re.compile(rf"(?<!\w){_TITLE}(?<=\.)\s({_TOKEN})")
_PART = re.compile(rf"{_TOKEN}")
# What stands before a person's name, and what makes a name a firm's, a street's or another thing's.
BEFORE = rf"(?:{_TITLE}|signed,?|witness:?|zeuge|zeugin|born\sas|i,|heirs\sof\sthe\slate|the\slate|tenant|executor|letters\sfor|claim\sof|against|niece|nephew|entered\sfor|contact|écrire\sà|sich\san|bei|de|by|both|and|[\w:]\s\||\n|\(|confirmed\sby|checked\swith)\s*$"
AFTER_FIRM = re.compile(r"\s*(?:&|and\sSons|et\sFils|und\sSöhne|[\w-]*\s?(?:Foundation|Institute|Trust|Co\b|Company|Ltd|Inc|Shipping|Savings|Bank|Bros|Sons|Council|Society|Press|Street|St\b|Road|Rd\b|Lane|Row|Avenue|Ave\b|Court|Hill|Place|Square))")
_BEFORE = re.compile(BEFORE, re.I)
#: What any match of ``BEFORE`` ends in, but for a line end.
_BEFORE_ENDS = tuple("mr mrs ms miss dr prof capt captain col rev herr herrn frau hr fr m mme mlle sr sra don doña madame monsieur sir lady . , : late signed witness zeuge zeugin as tenant executor for of against niece nephew contact à an bei de by both and | ( with".split())
_TITLE_START = re.compile(rf"{_TITLE}\s")


def _shape(text: str) -> str:
    return re.sub(r"[A-Z](?=[A-Z]?\s9|$)", "A", re.sub(r"\d", "9", re.sub(r"\s+", " ", text)))


def _number_votes(kind: str, shape: str, digits: int, before: str, text: str) -> list[int]:
    formats, words = (PHONES, _PHONE_WORDS) if kind == "phone" else (IDS, _ID_WORDS)
    other, theirs = (IDS, _ID_WORDS) if kind == "phone" else (PHONES, _PHONE_WORDS)
    fits = 1 if shape in formats else 0
    long = int((10 <= digits <= 13) if kind == "phone" else (8 <= digits <= 13))
    context = 1 if words.search(before) else 0 if theirs.search(before) else ABSTAIN
    against = 0 if _OTHER_WORDS.search(before) else ABSTAIN
    return [fits, long, context, against, 0 if shape in other else 1 if kind == "phone" and text[:1] in "+(" else ABSTAIN]


Candidate = tuple[str, int, int, list[int]]


def _emails(t: str) -> Iterator[Candidate]:
    for m in _EMAIL.finditer(t):
        local, domain = re.split(r"\s*(?:@|[(\[{]at[)\]}])\s*", m[0], maxsplit=1, flags=re.I)
        labels = re.split(r"\s?[\[({]dot[\])}]\s?|\.", domain, flags=re.I)
        yield "email", m.start(), m.end(), [int(len(labels) > 1), int(labels[-1].isalpha() and len(labels[-1]) > 1), int(any(c.isalpha() for c in local)), 0 if domain[0].isdigit() else ABSTAIN, int(not local.startswith("."))]


def _address(t: str, a: int, b: int) -> Candidate:
    s, before = t[a:b], t[max(0, a - CONTEXT) : a]
    return "address", a, b, [1, int("," in s) or ABSTAIN, 0 if _OTHER_WORDS.search(before) else ABSTAIN, 1 if _POST_CODE.search(s) else ABSTAIN, 1 if _PLACE_WORDS.search(before) else ABSTAIN]


_POST_CODE, _PLACE_WORDS = re.compile(r"\d{5}"), re.compile(r"(?:in|at|of|\||à|demeurant|haus|,|residing|live)\s*$", re.I)
_AT_SIGN = re.compile(r"at[)\]}]", re.I)
_EXTENSION = re.compile(r",?\s+(?:ext|Ext|x|Durchwahl|poste)\b")


def _numbers(t: str, a: int, b: int) -> list[Candidate]:
    s = t[a:b]
    core = _EXTENSION.split(s)[0]
    digits = sum(map(len, _FIGURES.findall(core)))
    if digits < 7:
        return []
    shape, before = _shape(core), t[max(0, a - CONTEXT) : a]
    if shape[:1] == "A" and shape[1:2] == "9":
        shape = "X" + shape[1:]
    return [(kind, a, b, _number_votes(kind, shape, digits, before, s)) for kind in ("phone", "id_number")]


def _number_at(t: str, at: int) -> re.Match | None:
    """The number whose first figure is at ``at``, with the sign and the letters before it."""
    sign = at - (at > 0 and t[at - 1] in "+(")
    if sign > 2 and t[sign - 1].isspace() and t[sign - 2].isupper() and (m := _NUMBER.match(t, sign - 3)):
        return m
    if sign and t[sign - 1].isupper():
        return _NUMBER.match(t, sign - 1)
    return _NUMBER.match(t, sign) or (_NUMBER.match(t, at) if sign < at else None)


def candidates(t: str) -> list[Candidate]:
    """Spans of the plain text that may be an e-mail address, postal address, telephone or identity number, with votes.

    All but the first are looked for around the figures of the text, as they all have some."""
    out: list[Candidate] = []
    if "@" in t or ((")" in t or "]" in t or "}" in t) and _AT_SIGN.search(t)):
        out += _emails(t)
    at_way = None
    english = french = german = number = last = 0
    for f in _FIGURES.finditer(t):
        a, b = f.span()
        if b - a < 5 and (t[b : b + 1].isupper() or t[b : b + 1] in _BEHIND_HOUSE):
            if a >= english and (m := _ENGLISH.match(t, a)):
                out.append(_address(t, a, english := m.end()))
            if a >= french and (m := _FRENCH.match(t, a)):
                out.append(_address(t, a, french := m.end()))
        if a >= german and a > 1 and t[a - 1].isspace():
            if at_way is None:
                at_way = any(h in t for h in _AT_STARTS)
            if at_way or t.endswith(_GERMAN_ENDS, 0, a - 1):
                for m in _NO_STREET.finditer(t, max(last, german), a):
                    last = m.end()
                if m := _GERMAN.search(t, max(last, german), a):
                    out.append(_address(t, m.start(), german := _GERMAN_NUMBER.match(t, a).end()))
        if a >= number and (m := _number_at(t, a)):
            number = m.end()
            out += _numbers(t, m.start(), number)
        last = b
    return out


def _hashed(*features: str) -> list[int]:
    return [zlib.crc32(x.encode("utf-8", "replace")) % TABLE for x in features]


_LETTER_RUN, _FIGURE_RUN = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def _word_form(w: str) -> str:
    return _FIGURE_RUN.sub("0", w.lower())


def _around(t: str, a: int, b: int) -> tuple[str, str, str]:
    """The last two words before a span and the first one behind it; a line end counts as the space it is."""
    before = t[max(0, a - CONTEXT) : a].split()
    behind = t[b : b + CONTEXT].split(None, 1)
    return _word_form(before[-1]) if before else "^", _word_form(before[-2]) if len(before) > 1 else "^", _word_form(behind[0]) if behind else "$"


def span_features(t: str, kind: str, a: int, b: int) -> list[int]:
    """Features of a candidate: the words around it, the characters next to it, its shape and length."""
    last, other, behind = _around(t, a, b)
    s = t[a:b]
    return _hashed("1" + last, "2" + other + " " + last, "3" + behind, "4" + t[a - 1 : a], "5" + t[b : b + 1], "6" + _shape(s) if kind != "address" else "6" + _LETTER_RUN.sub("a", _FIGURE_RUN.sub("0", s)), "7" + str(len(s) // 4), "8" + ("\n" if "\n" in s else ""))


Run = tuple[int, int, list[tuple[str, int, int]], int, int]


def runs(t: str) -> list[Run]:
    """Runs of capitalised words and initials that may hold a name: start, end, tokens, context vote before, vote after. Single words count behind a shortened title."""
    found = [m.span() for m in _RUN.finditer(t)]
    if ". " in t or ".\n" in t:
        many = found[:]
        found += [m.span(1) for m in _TITLED.finditer(t) if not any(a <= m.start(1) < b for a, b in many)]
    out: list[Run] = []
    for a, b in found:
        before = t[max(0, a - CONTEXT) : a]
        said = before.rstrip()
        trigger = ((said.lower().endswith(_BEFORE_ENDS) or "\n" in before[len(said) :]) and _BEFORE.search(before)) or _TITLE_START.match(t, a)
        out.append((a, b, [(x[0], x.start(), x.end()) for x in _PART.finditer(t, a, b)], 1 if trigger else ABSTAIN, 0 if AFTER_FIRM.match(t, b) else ABSTAIN))
    return out


_TITLE_WORD = re.compile(rf"{_TITLE}$")


def name_spans(tokens: list[tuple[str, int, int]], commas: list[bool], roles: list[int], listed: list[bool], before: int, after: int) -> list[tuple[int, int, list[int]]]:
    """Names in a run, with votes. roles: 1 given, 2 surname, 3 either, 0 neither, 4 an initial, 5 a title; commas: whether a comma follows the token."""
    out = []
    i, n = 0, len(tokens)
    while i < n:
        if roles[i] in (0, 5):
            i += 1
            continue
        j = i
        inverted = roles[i] in (2, 3) and commas[i] and i + 1 < n and roles[i + 1] in (1, 3) and (i + 2 >= n or commas[i + 1] or roles[i + 2] in (0, 1, 4, 5))
        if inverted:
            j = i + 1
            while j + 1 < n and roles[j + 1] == 4 and not commas[j]:
                j += 1
        else:
            while j + 1 < n and not commas[j] and roles[j + 1] in (1, 2, 3, 4):
                j += 1
                if roles[j] == 2 and (j + 1 >= n or roles[j + 1] in (1, 4, 0)):
                    break
        while j > i and roles[j] == 4 and not inverted:
            j -= 1
        own = roles[i : j + 1]
        names = [r for r in own if r != 4]
        title = i > 0 and roles[i - 1] == 5
        if names and (len(own) > 1 or title or before == 1):
            full = int((any(r in (1, 3, 4) for r in own) and any(r in (2, 3) for r in own) and len(own) > 1) or inverted)
            firm = after if j == n - 1 else ABSTAIN
            nearby = 1 if title or (i == 0 and before == 1) else ABSTAIN
            out.append((tokens[i][1], tokens[j][2], [full, 1 if any(listed[i : j + 1]) else ABSTAIN, nearby, firm, int(len(own) > 1 or title)]))
        i = j + 1
    return out


# --- the model --------------------------------------------------------------------------------------------------------


class Votes:
    """Reliabilities of the labelers of one type and the probability of each vector of votes, by expectation-maximisation."""

    def __init__(self, counts: dict[tuple[int, ...], float], rounds: int = 30) -> None:
        self.hit = [[0.9, 0.9]] * LABELERS  # probability of voting 1 given positive, of voting 0 given negative, if it votes
        self.prior = 0.6
        total = sum(counts.values())
        for _ in range(rounds):
            p = {v: self(v) for v in counts}
            self.prior = min(0.98, max(0.02, sum(n * p[v] for v, n in counts.items()) / total)) if total else self.prior
            fresh = []
            for k in range(LABELERS):
                pos = [sum(n * p[v] for v, n in counts.items() if v[k] == x) for x in (0, 1)]
                neg = [sum(n * (1 - p[v]) for v, n in counts.items() if v[k] == x) for x in (0, 1)]
                # ten imagined votes keep a labeler better than chance
                fresh.append([min(0.99, max(0.55, (pos[1] + 9) / (sum(pos) + 10))), min(0.99, max(0.55, (neg[0] + 9) / (sum(neg) + 10)))])
            self.hit = fresh

    def __call__(self, votes: tuple[int, ...]) -> float:
        a, b = math.log(self.prior), math.log(1 - self.prior)
        for v, (h, c) in zip(votes, self.hit):
            if v != ABSTAIN:
                a += math.log(h if v else 1 - h)
                b += math.log(1 - c if v else c)
        return 1 / (1 + math.exp(min(700, b - a)))


def _indices(votes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Columns of the features of every span: hashed ones, a column per labeler and vote, the constant."""
    of_votes = TABLE + 3 * np.arange(LABELERS) + votes + 1
    return np.concatenate([x, of_votes, np.full((len(x), 1), TABLE + 3 * LABELERS)], axis=1)


def train(votes: np.ndarray, x: np.ndarray, target: np.ndarray, rounds: int = 120, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic classifier of spans, trained on probabilities by gradient descent with a step of its own for each weight."""
    w, seen = np.zeros(TABLE + 3 * LABELERS + 1), np.full(TABLE + 3 * LABELERS + 1, 1e-8)
    if not len(x):
        return w
    at = _indices(votes, x)
    flat = at.ravel()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[at].sum(axis=1), -50, 50)))
        g = np.bincount(flat, weights=np.repeat(p - target, at.shape[1]), minlength=len(w)) / len(x) + ridge * w / len(x)
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
    return w


def probability(w: np.ndarray, votes: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[_indices(votes, x)].sum(axis=1), -50, 50)))


# --- Spark ------------------------------------------------------------------------------------------------------------


def texts(regions: DataFrame, jobs: DataFrame, reviewed: DataFrame) -> DataFrame:
    """The three text columns as (field, row_key, text), without null and empty texts."""
    of = lambda d, field, key: d.select(F.lit(field).alias("field"), F.col(key).alias("row_key"), F.col(field).alias("text"))
    return of(regions, "text_content", "region_key").unionByName(of(jobs, "markdown", "result_key")).unionByName(of(reviewed, "corrected_text", "hitl_key")).filter("text != ''")


#: One row per text. c_*: its candidates but names (type, start, end, votes, features of each); r_*: its runs (tokens, votes
#: before and behind, two features); w_*: their tokens (word, skeleton, start, end, whether a comma follows, whether listed).
_FOUND = "field string, row_key long, c_type array<int>, c_span array<long>, c_votes array<int>, c_x array<int>, r_size array<int>, r_votes array<int>, r_x array<int>, w array<string>, w_k array<string>, w_span array<long>, w_flags array<int>"
_SPANS = "field string, row_key long, types array<int>, at array<long>, votes array<int>, x array<int>"
NAME = TYPES.index("person_name")


def _extract(rows: DataFrame, given: frozenset[str], surnames: frozenset[str]) -> DataFrame:
    """Candidates of every text that has any; copies of a text in a batch are read once."""
    listed = given | surnames

    def found(text: str) -> tuple[list, ...] | None:
        t, at = plain(text)
        cands, many = candidates(t), runs(t)
        if not cands and not many:
            return None
        place = (lambda a, b: (a, b)) if at is None else (lambda a, b: (at[a], _end(text, at, b)))
        out: tuple[list, ...] = tuple([] for _ in range(11))
        c_type, c_span, c_votes, c_x, r_size, r_votes, r_x, w, w_k, w_span, w_flags = out
        for kind, a, b, votes in cands:
            c_type.append(TYPES.index(kind))
            c_span += place(a, b)
            c_votes += votes
            c_x += span_features(t, kind, a, b)
        mails = [(a, b) for kind, a, b, _ in cands if kind == "email"]
        for a, b, tokens, before, after in many:
            if mails:
                # a name ends before a mail address in capitals behind it
                cut = next((i for i, (_, c, d) in enumerate(tokens) if any(c < f and e < d for e, f in mails)), None)
                if cut == 0:
                    continue
                if cut:
                    tokens, after = tokens[:cut], ABSTAIN
                    b = tokens[-1][2]
            r_size.append(len(tokens))
            r_votes += (before, after)
            last, _, behind = _around(t, a, b)
            r_x += _hashed("1" + last, "3" + behind)
            for x, c, d in tokens:
                x = x.casefold()
                w.append(x)
                w_k.append(skeletons(x)[0] if len(x) > 4 else "")
                w_span += place(c, d)
                w_flags += (int(t[d : d + 1] == ","), int(x in listed or ("-" in x and any(p in listed for p in x.split("-")))))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _FOUND.split(", ")]
        for pdf in batches:
            done = {x: found(x) for x in dict.fromkeys(pdf["text"])}
            yield pd.DataFrame([(field, key, *got) for field, key, x in zip(pdf["field"], pdf["row_key"], pdf["text"]) if (got := done[x])], columns=columns)

    return rows.mapInPandas(run, _FOUND)


def _initial(w: str) -> bool:
    return len(w) == 2 and w[1] == "."


def _meetings(ws: list[str], commas: list[bool], given: frozenset[str], surnames: frozenset[str], sums: dict[tuple[str, int], list[int]]) -> None:
    """Counts for every word of a run where it stands as a surname (2) or a given name (1) by a listed part, and where at all."""
    known = lambda w: w in surnames or ("-" in w and any(x in surnames for x in w.split("-")))
    n = len(ws)
    for i, w in enumerate(ws):
        if len(w) < 3 or _TITLE_WORD.match(w.title()):
            continue
        j = i - 1
        while j > 0 and _initial(ws[j]):
            j -= 1
        first = j >= 0 and not commas[j] and ws[j] in given  # stands behind a given name
        # "SURNAME, Given" and nothing but initials behind it
        inverted = i + 1 < n and commas[i] and ws[i + 1] in given and (commas[i + 1] or all(map(_initial, ws[i + 2 :])))
        k = i + 1
        while k + 1 < n and _initial(ws[k]):
            k += 1
        last = k < n and not commas[i] and known(ws[k]) and not commas[k]
        other = i > 0 and commas[i - 1] and known(ws[i - 1])
        for role, yes in ((2, first or inverted), (1, last or other)):
            got = sums.get((w, role))
            if got is None:
                sums[w, role] = [int(yes), 1]
            else:
                got[0] += yes
                got[1] += 1


def _roles(found: DataFrame, given: frozenset[str], surnames: frozenset[str]) -> DataFrame:
    """word -> role (1 given, 2 surname, 3 either): the gazetteer and what the corpus adds to it; misread parts by ``~`` and the skeleton of problem 6."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, int], list[int]] = {}
        for pdf in batches:
            for sizes, w, flags in zip(pdf["r_size"], pdf["w"], pdf["w_flags"]):
                w, commas, at = w.tolist(), flags[::2].tolist(), 0
                for n in sizes.tolist():
                    _meetings(w[at : at + n], commas[at : at + n], given, surnames, sums)
                    at += n
        yield pd.DataFrame([(w, r, a, b) for (w, r), (a, b) in sums.items()], columns=["w", "role", "met", "seen"])

    met = found.filter("size(r_size) > 0").select("r_size", "w", "w_flags").mapInPandas(meet, "w string, role int, met long, seen long").groupBy("w", "role").agg(F.sum("met").alias("met"), F.sum("seen").alias("seen"))
    own = met.filter(F.col("met") / (F.col("seen") + DOUBT) >= MEETING_SHARE).select("w", "role")
    listed = [(w, 1) for w in sorted(given)] + [(w, 2) for w in sorted(surnames)]
    if listed:
        own = own.unionByName(found.sparkSession.createDataFrame(listed, "w string, role int"))
    roles = own.groupBy("w").agg(F.bit_or("role").alias("role"))
    roles = materialise(roles, "p5-roles")

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["w"].str.len() > 4]
            yield pd.DataFrame({"w": ["~" + skeletons(w)[0] for w in pdf["w"]], "role": pdf["role"].to_numpy()})

    return materialise(roles.unionByName(roles.mapInPandas(alike, "w string, role int").groupBy("w").agg(F.max("role").alias("role"))), "p5-all-roles")


def _role(w: str, k: str, roles: dict[str, int]) -> int:
    if _initial(w):
        return 4
    if _TITLE_WORD.match(w.title()):
        return 5
    got = roles.get(w)
    if got:
        return got
    if "-" in w:
        parts = [roles.get(p.strip(), 0) for p in w.split("-")]
        if any(parts):
            return 2 if 2 in parts else parts[0]
    return roles.get("~" + k, 0) if k else 0


def _names_of(sizes: list[int], r_votes: list[int], r_x: list[int], w: list[str], w_k: list[str], span: list[int], flags: list[int], roles: dict[str, int]) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """Names of a text's runs: start, end, votes, features."""
    at = 0
    for r, n in enumerate(sizes):
        ws = w[at : at + n]
        own = [_role(x, k, roles) for x, k in zip(ws, w_k[at : at + n])]
        before, after = r_votes[2 * r : 2 * r + 2]
        if any(0 < x < 4 for x in own) or before == 1:
            # Monsieur, where a given name follows; else an initial
            own = [5 if x == "m." and i + 1 < n and own[i + 1] == 1 else o for i, (x, o) in enumerate(zip(ws, own))]
            tokens = [(x, span[2 * i], span[2 * i + 1]) for i, x in enumerate(ws, at)]
            commas, listed = [bool(x) for x in flags[2 * at : 2 * (at + n) : 2]], [bool(x) for x in flags[2 * at + 1 : 2 * (at + n) : 2]]
            of = {a: i for i, (_, a, _) in enumerate(tokens)} | {-b: i for i, (_, _, b) in enumerate(tokens)}
            for a, b, votes in name_spans(tokens, commas, own, listed, before, after):
                i, j = of[a], of[-b]
                x = _hashed("4" + "".join(map(str, own[i : j + 1])), "5" + (ws[i - 1] if i else ""), "6" + (ws[j + 1] if j + 1 < n else ""), "7" + str(j - i), "8" + str(any(commas[i:j])), "9" + str(min(4, i)))
                yield a, b, votes, [r_x[2 * r] if i == 0 else TABLE - 1, r_x[2 * r + 1] if j == n - 1 else TABLE - 2, *x]
        at += n


def _spans(found: DataFrame, roles: DataFrame) -> DataFrame:
    """All spans of every text that has any, and beside them, with a null field, how often each vector of votes is met (in row_key)."""
    few = small_rows(roles, BOUND)
    if few is not None:
        sent = found.sparkSession.sparkContext.broadcast({r["w"]: r["role"] for r in few})
    else:
        # the roles of the words of each text are joined to it; frequent words are spread over several keys
        found = materialise(found.withColumn("rid", F.monotonically_increasing_id()), "p5-numbered")
        ask = F.array_distinct(F.flatten(F.array(F.col("w"), F.flatten(F.transform("w", lambda x: F.split(x, "-"))), F.transform(F.filter("w_k", lambda k: k != ""), lambda k: F.concat(F.lit("~"), k)))))
        words = found.filter("size(w) > 0").select("rid", F.explode(ask).alias("w")).withColumn("salt", (F.col("rid") % 16).cast("int"))
        salted = roles.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        known = words.join(salted, ["w", "salt"]).groupBy("rid").agg(F.collect_list(F.struct("w", "role")).alias("roles"))
        found = found.join(known, "rid", "left").drop("rid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _SPANS.split(", ")]
        counts: Counter = Counter()
        for pdf in batches:
            out = []
            each = pdf["roles"] if few is None else [None] * len(pdf)
            for r, got in zip(pdf.itertuples(index=False), each):
                roles = sent.value if few is not None else {x["w"]: x["role"] for x in (got if got is not None else [])}
                types, at, votes, x = r.c_type.tolist(), r.c_span.tolist(), r.c_votes.tolist(), r.c_x.tolist()
                if len(r.r_size):
                    for a, b, v, fs in _names_of(r.r_size.tolist(), r.r_votes.tolist(), r.r_x.tolist(), r.w.tolist(), r.w_k.tolist(), r.w_span.tolist(), r.w_flags.tolist(), roles):
                        types.append(NAME)
                        at += (a, b)
                        votes += v
                        x += fs
                for i, kind in enumerate(types):
                    counts[kind, *votes[LABELERS * i : LABELERS * (i + 1)]] += 1
                if types:
                    out.append((r.field, r.row_key, types, at, votes, x))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([(None, n, [kind], None, votes, None) for (kind, *votes), n in counts.items()], columns=columns)

    return found.mapInPandas(run, _SPANS)


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.concatenate([*column, np.zeros(0, dtype=np.int64)]).astype(np.int64).reshape(-1, width)


def _model(spans: DataFrame) -> dict[int, np.ndarray]:
    """Weights of the classifier of each type."""
    rows = spans.filter("field is null").groupBy(F.col("types")[0].alias("kind"), "votes").agg(F.sum("row_key").alias("n")).collect()
    counts: dict[int, dict[tuple[int, ...], float]] = {}
    for r in rows:
        counts.setdefault(r["kind"], {})[tuple(r["votes"])] = float(r["n"])
    share = {kind: SAMPLE / sum(c.values()) for kind, c in counts.items()}

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                for i, kind in enumerate(r.types.tolist()):
                    h = zlib.crc32(f"{r.row_key} {r.field} {r.at[2 * i]} {kind}".encode())
                    if h < share[kind] * 2**32:
                        out.append((kind, h, r.votes[LABELERS * i : LABELERS * (i + 1)], r.x[FEATURES * i : FEATURES * (i + 1)]))
            yield pd.DataFrame(out, columns=["kind", "h", "votes", "x"])

    sample = spans.filter("field is not null").mapInPandas(draw, "kind int, h long, votes array<int>, x array<int>").collect()
    model = {}
    for kind, c in counts.items():
        own = sorted(((r["h"], r["votes"], r["x"]) for r in sample if r["kind"] == kind))
        em = Votes(c)
        votes, x = np.array([v for _, v, _ in own], dtype=np.int64).reshape(-1, LABELERS), np.array([x for *_, x in own], dtype=np.int64).reshape(-1, FEATURES)
        model[kind] = train(votes, x, np.array([em(tuple(v)) for _, v, _ in own]))
    return model


def find(rows: DataFrame, name_parts: DataFrame) -> DataFrame:
    """(field, row_key, pii_type, char_start, char_end). ``name_parts`` is a fixed table of a few rows."""
    parts = name_parts.filter("spelling is not null").select("kind", "spelling").collect()
    given, surnames = (frozenset(r["spelling"].casefold() for r in parts if r["kind"] == kind) for kind in ("given", "surname"))
    found = materialise(_extract(rows, given, surnames), "p5-candidates")
    spans = materialise(_spans(found, _roles(found, given, surnames)), "p5-spans")
    model = _model(spans)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf["types"].map(len).to_numpy()
            types, at, votes, x = (_matrix(pdf[c], n) for c, n in (("types", 1), ("at", 2), ("votes", LABELERS), ("x", FEATURES)))
            types = types.ravel()
            yes = np.zeros(len(types), dtype=bool)
            for kind in np.unique(types):
                own = np.flatnonzero(types == kind)
                yes[own] = probability(model[kind], votes[own], x[own]) >= 0.5
            row = np.repeat(np.arange(len(pdf)), sizes)[yes]
            kept: dict[int, list[tuple[int, int, int]]] = {}
            for r, kind, (a, b) in zip(row.tolist(), types[yes].tolist(), at[yes].tolist()):
                kept.setdefault(r, []).append((a, b, kind))
            fields, keys, out = pdf["field"].to_numpy(), pdf["row_key"].to_numpy(), []
            for r, each in kept.items():
                # longest first; a span that overlaps one already taken is left out
                taken: list[tuple[int, int, int]] = []
                for a, b, kind in sorted(set(each), key=lambda s: (s[0] - s[1], s[2], s[0])) if len(each) > 1 else each:
                    if not any(a < d and c < b for c, d, _ in taken):
                        taken.append((a, b, kind))
                out += [(fields[r], keys[r], TYPES[kind], a, b) for a, b, kind in taken]
            yield pd.DataFrame(out, columns=["field", "row_key", "pii_type", "char_start", "char_end"])

    return spans.filter("field is not null").mapInPandas(decide, "field string, row_key long, pii_type string, char_start long, char_end long")


def redacted(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(field, row_key, redacted): every text with ``[TYPE]`` in place of its spans; texts without any as they are."""
    each = spans.groupBy("field", "row_key").agg(F.sort_array(F.collect_list(F.struct("char_start", "char_end", "pii_type"))).alias("spans"))
    joined = rows.join(each, ["field", "row_key"], "left")
    cut = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), lambda acc, x: F.struct(F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (x["char_start"] - acc["at"]).cast("int")), F.lit("["), F.upper(x["pii_type"]), F.lit("]")).alias("out"), x["char_end"].alias("at")), lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    return joined.select("field", "row_key", F.coalesce(cut, F.col("text")).alias("redacted"))
