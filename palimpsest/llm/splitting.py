"""Problem 4: cutting oversized Markdown at natural boundaries, with a fixed overlap.

A dynamic programme over boundary positions minimises the sum of cut penalties and of squared size imbalance, subject
to the length limit. Boundaries, from the cheapest: page-break line, heading line, blank line, line end, end of a
sentence, blank, any character. A cut inside front matter, a comment, a formula block or a fenced block costs more than
any cut outside them. The penalties are far enough apart that a worse kind is used only where no better one is within
reach of the limit.

Every piece but the first starts ``overlap`` characters before the end of the one before it, so the pieces without
their overlaps put together are the text. Null and empty text give no piece, a text within the limit gives itself, a
repeated row its own pieces. Lengths and positions count code points; line ends are ``\\n``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS, OVERLAP = 3000, 200
PENALTY = {"page": 0.0, "heading": 1.0, "paragraph": 40.0, "line": 400.0, "sentence": 4e3, "blank": 4e4, "any": 4e6}
INSIDE = 4e5  # for a cut inside a protected block
BALANCE = 10.0  # of a piece that leaves the whole room unused

_HEADING = re.compile(r"#{1,6} ")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_KEY = re.compile(r"[\w.-]+\s*:")
_SENTENCE = re.compile(r"[.!?。！？؟।…]+[\"'”’»)\]]*(?=\s)|[。！？][」』”’]*")

_BLANK = re.compile(r"\s(?=\S)")


def scan(text: str) -> tuple[list[tuple[int, str]], list[tuple[int, int]]]:
    """Line starts with their kind (page, heading, paragraph after a blank line, line), and the protected spans."""
    lines, at = [], 0
    for x in text.split("\n"):
        lines.append((at, x))
        at += len(x) + 1
    starts: list[tuple[int, str]] = []
    spans: list[tuple[int, int]] = []
    i, n, blank = 0, len(lines), False
    if n > 2 and lines[0][1] == "---" and _KEY.match(lines[1][1]):
        end = next((k for k in range(1, n) if lines[k][1] == "---"), None)
        if end is not None:
            spans.append((0, lines[end][0] + 3))
            starts += [(p, "line") for p, _ in lines[1 : end + 1]]
            i = end + 1
    while i < n:
        at, x = lines[i]
        fence = _FENCE.match(x)
        last = i  # of a block that begins here
        if fence and not (fence[1][0] == "`" and "`" in fence[2]):
            close = re.compile(rf" {{0,3}}{fence[1][0]}{{{len(fence[1])},}}\s*$")
            last = next((k for k in range(i + 1, n) if close.match(lines[k][1])), n - 1)
        elif x.strip().startswith("$$") and x.count("$$") == 1:
            last = next((k for k in range(i + 1, n) if "$$" in lines[k][1]), i)
        elif "<!--" in x and "-->" not in x[x.rindex("<!--") :]:
            last = next((k for k in range(i + 1, n) if "-->" in lines[k][1]), n - 1)
        if last == i and not fence:
            kind = "page" if x == "---" else "heading" if _HEADING.match(x) else "paragraph" if blank and x.strip() else "line"
            starts.append((at, kind))
        else:
            starts += [(at, "paragraph" if blank else "line"), *((p, "line") for p, _ in lines[i + 1 : last + 1])]
            spans.append((at, lines[last][0] + len(lines[last][1])))
        blank = not x.strip() and last == i
        i = last + 1
    return starts, spans


def _natural(starts: list[tuple[int, str]]) -> list[tuple[int, str]]:
    return [(p, kind) for p, kind in starts if kind in ("page", "heading")]


def boundaries(text: str) -> list[tuple[int, str]]:
    """Positions of heading and page-break lines outside front matter, comments, formula blocks and fenced blocks."""
    return _natural(scan(text)[0])


def cut(text: str, limit: int = MAX_CHARS, overlap: int = OVERLAP, scanned: tuple[list[tuple[int, str]], list[tuple[int, int]]] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind of the boundary at the end) of each piece; ``limit`` must be more than ``overlap``. ``scanned``: what ``scan`` gave, if it was called."""
    n = len(text)
    if n <= limit:
        return [(0, n, "end")] if n else []
    starts, spans = scanned or scan(text)
    room = limit - overlap
    kinds = {p: k for p, k in starts if 0 < p < n}
    # the next worse kind comes in where boundaries so far are further apart than a piece may grow
    for kind, pattern in (("sentence", _SENTENCE), ("blank", _BLANK), ("any", None)):
        ordered = sorted(kinds)
        for a, b in zip([0, *ordered], [*ordered, n]):
            if b - a > room:
                found = range(a + 1, b) if pattern is None else (m.end() for m in pattern.finditer(text, a, b))
                kinds |= {p: kind for p in found if a < p < b and p not in kinds}
    pos = np.array([0, *sorted(kinds), n])
    pen = np.array([0.0, *(PENALTY[kinds[p]] for p in pos[1:-1].tolist()), 0.0])
    if spans:
        lo, hi = np.array(spans).T
        k = np.searchsorted(lo, pos, side="left") - 1
        pen += np.where((k >= 0) & (pos < hi[k]), INSIDE, 0.0)
    best, back = np.full(len(pos), np.inf), np.zeros(len(pos), dtype=np.int64)
    best[0] = 0.0
    first = 0
    for j in range(1, len(pos)):
        while pos[j] - pos[first] > (limit if first == 0 else room):
            first += 1
        size = pos[j] - pos[first:j] + np.where(np.arange(first, j) > 0, overlap, 0)
        cost = best[first:j] + BALANCE * (1 - size / limit) ** 2
        k = int(cost.argmin())
        best[j], back[j] = cost[k] + pen[j], first + k
    ends, j = [], len(pos) - 1
    while j:
        ends.append(j)
        j = int(back[j])
    out, at = [], 0
    for j in reversed(ends):
        out.append((max(0, at - overlap), int(pos[j]), kinds.get(int(pos[j]), "end")))
        at = int(pos[j])
    return out


_SPLIT = "boundaries array<long>, pieces array<struct<piece_no:int,char_start:long,char_end:long,end_kind:string,piece:string>>"


def split(jobs: DataFrame, key: str, text: str, limit: int, overlap: int) -> DataFrame:
    """One row per text, from one pass over it: its page and heading boundaries and the pieces the programme cuts it into."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text]):
                scanned = scan(t)
                found = [{"piece_no": i, "char_start": a, "char_end": b, "end_kind": kind, "piece": t[a:b]} for i, (a, b, kind) in enumerate(cut(t, limit, overlap, scanned))]
                rows.append((k, [p for p, _ in _natural(scanned[0])], found))
            yield pd.DataFrame(rows, columns=[key, "boundaries", "pieces"])

    return jobs.select(key, text).mapInPandas(run, f"{key} long, {_SPLIT}")


def boundary_positions(jobs: DataFrame, key: str = "result_key", text: str = "markdown", limit: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """The page and heading boundaries that the cutting of every oversized text has to choose from."""
    return split(jobs.filter(F.length(text) > limit), key, text, limit, overlap).select(key, F.explode("boundaries").alias("char_pos"))


def pieces(jobs: DataFrame, key: str = "result_key", text: str = "markdown", limit: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every text: key, piece_no, char_start, char_end, end_kind, piece."""
    return split(jobs.filter(F.length(text) > 0), key, text, limit, overlap).select(key, F.inline("pieces"))
