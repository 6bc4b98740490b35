"""Problem 1: one consistent form for texts that look the same.

Look-alike classes are built by union-find over strings and code points, each class gets its most frequent member as
representative, and texts are rewritten greedily (leftmost, longest) by a multi-pattern automaton.

Edges of the union-find, for the code points that occur in the corpus:

* canonical equivalence (a composed letter and its base plus marks, in every mixture of alike bases and marks),
* wide, narrow, no-break, contextual and ligature forms and the text they stand for,
* letters of Latin, Greek, Cyrillic and Armenian that are drawn alike (``TWINS``),
* every kind of blank and the plain blank, every invisible character and nothing, every line separator and ``\\n``.

Raised and lowered figures, fractions, circled forms and font variants look different and stay apart, and so do a
letter and a digit. Null text stays null, empty text stays empty; the number of blanks in a run is kept.
"""

from __future__ import annotations

import itertools
import re
import unicodedata as ud
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts drawn like the Latin letter on the left (Greek, then Cyrillic and others).
TWINS = {
    "A": "ΑА", "B": "ΒВ", "C": "С", "E": "ΕЕ", "F": "Ϝ", "G": "Ԍ", "H": "ΗН", "I": "ΙІӀ", "J": "ͿЈ", "K": "ΚК",
    "M": "ΜМ", "N": "Ν", "O": "ΟОՕ", "P": "ΡР", "Q": "Ԛ", "S": "Ѕ", "T": "ΤТ", "V": "Ѵ", "W": "Ԝ", "X": "ΧХ",
    "Y": "ΥҮ", "Z": "Ζ", "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ",
    "n": "ո", "o": "οоօ", "p": "р", "q": "ԛ", "s": "ѕ", "u": "ս", "v": "νѵ", "w": "ԝ", "x": "х", "y": "у",
}
#: Compatibility tags of the Unicode character data under which the look is kept.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Visible characters of category Cf (signs that enclose or precede digits).
VISIBLE_FORMAT = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
#: Invisible characters outside category Cf.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: Hyphens drawn like the ASCII one.
HYPHENS = "\u2010\u2011"
LINE_ENDS = "\x0b\x0c\x85  "


class Classes:
    """Union-find with path halving over strings (single code points are strings of length one)."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def groups(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return out


def is_invisible(ch: str) -> bool:
    n = ord(ch)
    return n in INVISIBLE or ch == "\r" or (ud.category(ch) == "Cf" and n not in VISIBLE_FORMAT)


def _compat(ch: str) -> str | None:
    """What a wide, narrow or joined form stands for, if it looks like that."""
    tag, _, rest = ud.decomposition(ch).partition(" ")
    if tag not in SAME_LOOK or not rest:
        return None
    out = "".join(chr(int(x, 16)) for x in rest.split())
    return None if tag == "<compat>" and (out[0] == " " or any(ud.category(c)[0] not in "LMP" for c in out)) else out


@lru_cache(1)
def fixed_forms() -> dict[str, str]:
    """What each character outside ASCII that looks like other text looks like, whatever the corpus: a letter drawn alike, the plain blank, what a wide, narrow or joined form stands for, or nothing. Line ends are left."""
    out = {c: a for a, bs in TWINS.items() for c in bs}
    for n in [*range(0x80, 0x3200), *range(0xFB00, 0xFB50), *range(0xFE00, 0x10000)]:
        c = chr(n)
        if c in out or c in "\x85\u2028\u2029":
            continue
        if is_invisible(c):
            out[c] = ""
        elif ud.category(c) == "Zs":
            out[c] = " "
        elif ud.decomposition(c).partition(" ")[0] in ("<wide>", "<narrow>", "<noBreak>", "<compat>") and not (to := ud.normalize("NFKC", c)).startswith(" "):
            out[c] = to
    return out


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """Every string that isn't its class's representative -> the representative, from code point counts of the corpus.

    The frequency of a string of several code points is taken as that of its rarest code point; ties go to the
    smallest string. Empty counts give an empty mapping."""
    classes, seen = Classes(), set(counts)
    twins = [(a, b) for a, bs in TWINS.items() for b in bs]
    for a, b in twins:
        if b in seen:
            classes.union(a, b)
    for ch in sorted(seen):
        if is_invisible(ch):
            classes.union(ch, "")
        elif ud.category(ch) == "Zs" or ch == "\t":
            classes.union(ch, " ")
        elif ch in HYPHENS:
            classes.union(ch, "-")
        elif ch in LINE_ENDS:
            classes.union(ch, "\n")
        elif out := _compat(ch):
            classes.union(ch, out)
            for x in out:
                if y := _compat(x):
                    classes.union(x, y)
    # composed letters: those seen, and those that seen bases and marks can make
    members: dict[str, list[str]] = {}
    for xs in classes.groups().values():
        for x in xs:
            members[x] = [y for y in xs if len(y) == 1]
    alike = lambda c: members.get(c, [c])
    bases = {y for c in seen if ud.category(c)[0] == "L" for y in [c, *alike(c)]}
    marks = {y for c in seen for x in ud.normalize("NFD", c) for y in [x, *alike(x)] if ud.combining(y)}
    composed = {c for c in seen if ud.normalize("NFD", c) != c and not ud.decomposition(c).startswith("<") and not 0xAC00 <= ord(c) <= 0xD7A3}
    composed |= {x for b in bases for m in marks if len(x := ud.normalize("NFC", b + m)) == 1}
    for x in sorted(composed):
        full = ud.normalize("NFD", x)
        for string in map("".join, itertools.product(*([c, *alike(c)] for c in full))):
            classes.union(x, string)
            if len(short := ud.normalize("NFC", string)) == 1:
                classes.union(x, short)
    weight = lambda s: min((counts.get(c, 0) for c in s), default=0)
    out: dict[str, str] = {}
    for xs in classes.groups().values():
        best = "" if "" in xs else min(xs, key=lambda s: (-weight(s), s))
        out |= {x: best for x in xs if x != best and x}
    return out


class Rewriter:
    """Rewrites texts by a table of representatives until they stay the same; ``rewrite(rewrite(t)) == rewrite(t)``."""

    def __init__(self, table: dict[str, str]) -> None:
        # a text without any of these, and composed already, is what it should be
        first = {k[0] for k in table}
        self.odd = re.compile("[" + "".join(map(re.escape, sorted(first))) + "]") if first else None
        gone = "".join(k for k, v in table.items() if not v)
        self.invisible = re.compile(f"[{re.escape(gone)}]") if gone else None
        self.automaton = ahocorasick.Automaton()
        for k, v in table.items():
            if v:
                self.automaton.add_word(k, (len(k), v))
        self.plain_ascii = not any(k.isascii() for k in table)
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def _once(self, text: str) -> str:
        if self.invisible:
            text = self.invisible.sub("", text)
        text = ud.normalize("NFC", text)
        if self.empty:
            return text
        out, at = [], 0
        for end, (n, v) in self.automaton.iter_long(text):
            out += (text[at : end - n + 1], v)
            at = end + 1
        return "".join([*out, text[at:]]) if out else text

    def __call__(self, text: str | None) -> str | None:
        if text is None or (self.plain_ascii and text.isascii()) or (not (self.odd and self.odd.search(text)) and ud.is_normalized("NFC", text)):
            return text
        seen: list[str] = []
        while text not in seen:
            seen.append(text)
            text = self._once(text)
        # forms that lead to each other come to the least of them
        return min(seen[seen.index(text) :])


def count_code_points(texts: DataFrame, column: str) -> dict[str, int]:
    """Code point counts over all texts of ``column``, combined per batch before the shuffle. What reaches the driver is bounded by the 1,114,112 code points of Unicode."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0x110000, dtype=np.int64)
        for pdf in batches:
            points = np.frombuffer("".join(pdf[column].dropna()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            total += np.bincount(points, minlength=len(total))
        met = np.flatnonzero(total)
        yield pd.DataFrame({"cp": met, "n": total[met]}, dtype="int64")

    rows = texts.select(column).mapInPandas(partial, "cp long, n long").groupBy("cp").agg(F.sum("n").alias("n")).collect()
    return {chr(r["cp"]): r["n"] for r in rows}


_rewriters: dict[int, tuple[dict, Rewriter]] = {}


def rewriter(table: dict[str, str]) -> Rewriter:
    """The rewriter of a table, built once in a Python worker."""
    key = hash(frozenset(table.items()))
    if key not in _rewriters:
        _rewriters[key] = (table, Rewriter(table))
    return _rewriters[key][1]


def canonical(column: Column, table: dict[str, str]) -> Column:
    """The consistent form of a text column."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        rewrite, done = rewriter(table), {}
        return texts.map(lambda t: done[t] if t in done else done.setdefault(t, rewrite(t)), na_action="ignore")

    return run(column)


def readings(aligned: DataFrame, key: str = "aligned_key") -> DataFrame:
    """One row per non-null reading: key, engine, text."""
    return aligned.select(F.col(key), F.explode("engine_texts").alias("e")).select(key, "e.engine", "e.text").filter("engine is not null and text is not null")


def lookalike_table(texts: DataFrame, column: str) -> dict[str, str]:
    """Representatives for the corpus of ``texts[column]``."""
    return representatives(count_code_points(texts, column))


def lookalike_pairs(aligned: DataFrame, key: str = "aligned_key") -> DataFrame:
    """Pairs of entries of one ``engine_texts`` that differ as stored but have the same consistent form.

    Null arrays, entries, engines and texts give no pair; a repeated row under another key gives its own pairs; two
    entries of the same engine (not expected) are compared as well when their names differ. Other columns of
    ``aligned`` are ignored, whatever their names."""
    table = lookalike_table(readings(aligned, key), "text")
    usable = F.filter("engine_texts", lambda e: e["engine"].isNotNull() & e["text"].isNotNull())
    rows = aligned.select(key, usable.alias("e")).filter(F.size(F.array_distinct(F.transform("e", lambda e: e["text"]))) > 1)

    def pairs(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewrite = rewriter(table)
        for pdf in batches:
            out = []
            for k, entries in zip(pdf[key], pdf["e"]):
                entries = sorted((e["engine"], e["text"]) for e in entries)
                forms = {t: rewrite(t) for _, t in entries}
                out += [(k, a, b) for (a, x), (b, y) in itertools.combinations(entries, 2) if a < b and x != y and forms[x] == forms[y]]
            yield pd.DataFrame(out, columns=[key, "engine_a", "engine_b"])

    return rows.mapInPandas(pairs, f"{key} long, engine_a string, engine_b string")
