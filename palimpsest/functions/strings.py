"""String functions: alignment and similarity as Arrow-batched functions, guards and rendering as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

GAP = "\x00"
MATCH, MISMATCH, SPACE = 2, -1, -2

# Patterns of fields whose value must not be invented.
LEGAL_FIELDS = {
    "dollar_amount": r"\$[\d,]+(?:\.\d{2})?",
    "date_mdy_slash": r"\d{1,2}/\d{1,2}/\d{2,4}",
    "date_written": r"(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}",
    "case_citation": r"\d+\s+[A-Z]\.\w+\s+\d+",
    "statute_ref": r"\d+\s+(?:U\.?S\.?C\.?|USC)\s*(?:§|SS)\s*\d+",
    "percentage": r"\d+(?:\.\d+)?%",
}


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


# --- alignment --------------------------------------------------------------------------------------------------------


def needleman_wunsch(a: str, b: str) -> tuple[str, str]:
    """Global alignment of two strings, gaps as ``GAP``: +2 equal, -1 unequal, -2 gap; on ties the diagonal, then a gap in b.

    Rows are filled at once: the best without a gap in ``a`` comes from the row above, gaps along the row are a running maximum."""
    a, b = a.replace(GAP, ""), b.replace(GAP, "")
    n, m = len(a), len(b)
    x, y = np.array([ord(c) for c in a], dtype=np.int64), np.array([ord(c) for c in b], dtype=np.int64)
    steps = np.arange(m + 1, dtype=np.int64) * SPACE
    rows = np.empty((n + 1, m + 1), dtype=np.int32)
    rows[0] = steps
    for i in range(1, n + 1):
        up = rows[i - 1].astype(np.int64)
        best = up + SPACE
        best[1:] = np.maximum(best[1:], up[:-1] + np.where(y == x[i - 1], MATCH, MISMATCH))
        rows[i] = np.maximum.accumulate(best - steps) + steps
    left, right = [], []
    i, j = n, m
    while i or j:
        here = rows[i, j]
        if i and j and here == rows[i - 1, j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH):
            i, j = i - 1, j - 1
            left.append(a[i])
            right.append(b[j])
        elif i and here == rows[i - 1, j] + SPACE:
            i -= 1
            left.append(a[i])
            right.append(GAP)
        else:
            j -= 1
            left.append(GAP)
            right.append(b[j])
    return "".join(reversed(left)), "".join(reversed(right))


LONG = 1000


def _scores(a: str, b: str) -> np.ndarray:
    """Last row of the score table, in linear space."""
    y = np.array([ord(c) for c in b], dtype=np.int64)
    steps = np.arange(len(b) + 1, dtype=np.int64) * SPACE
    row = steps.copy()
    for c in a:
        best = row + SPACE
        best[1:] = np.maximum(best[1:], row[:-1] + np.where(y == ord(c), MATCH, MISMATCH))
        row = np.maximum.accumulate(best - steps) + steps
    return row


def align(a: str, b: str) -> tuple[str, str]:
    """``needleman_wunsch`` between equal ends, which are aligned with each other at no loss; in linear space by halving where a text is longer than ``LONG``."""
    a, b = a.replace(GAP, ""), b.replace(GAP, "")
    head, most = 0, min(len(a), len(b))
    while head < most and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    if head or tail:
        l, r = align(a[head : len(a) - tail], b[head : len(b) - tail])
        end = a[len(a) - tail :]
        return a[:head] + l + end, a[:head] + r + end
    if max(len(a), len(b)) <= LONG or len(a) < 2 or len(b) < 2:
        return needleman_wunsch(a, b)
    mid = len(a) // 2
    at = int((_scores(a[:mid], b) + _scores(a[mid:][::-1], b[::-1])[::-1]).argmax())
    l, r = align(a[:mid], b[:at]), align(a[mid:], b[at:])
    return l[0] + r[0], l[1] + r[1]


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the shorter string."""
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for c in a:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


def indel_ratio(a: str, b: str) -> float:
    return 2.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def indel_similarity(a: Column | str, b: Column | str) -> Column:
    """Similarity of two texts under insertions and deletions, 0 to 1; null if one is null."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")

    return run(a, b)


def aligned_pair(a: Column | str, b: Column | str) -> Column:
    """Struct of both texts with gaps; null if one is null."""

    @F.pandas_udf("struct<a:string,b:string>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        got = [(None, None) if x is None or y is None else align(x, y) for x, y in zip(a, b)]
        return pd.DataFrame(got, columns=["a", "b"])

    return run(a, b)


# --- guards of arbitrated text ----------------------------------------------------------------------------------------


def within_edits(output: Column, candidates: Column, most: int) -> Column:
    """Whether a text is at most so many edits from any of the candidates."""
    return F.exists(candidates, lambda c: F.levenshtein(output, c, most) >= 0)


def inserts_run(output: Column, candidates: Column, run: int = 5) -> Column:
    """Whether more than ``run`` consecutive characters of a text stand in no candidate."""
    n = run + 1
    starts = F.when(F.length(output) >= n, F.sequence(F.lit(1), F.length(output) - run)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: ~F.exists(candidates, lambda c: F.contains(c, F.substring(output, i, F.lit(n)))))


def legal_values(text: Column, field: str) -> Column:
    return F.regexp_extract_all(text, F.lit(LEGAL_FIELDS[field]), F.lit(0))


def invented_values(output: Column, candidates: Column) -> Column:
    """``field: value`` for every value of a legal field that no candidate has, by field and then in order of value."""

    def of(field: str) -> Column:
        known = F.flatten(F.transform(candidates, lambda c: legal_values(c, field)))
        return F.transform(F.array_sort(F.array_except(legal_values(output, field), known)), lambda v: F.concat(F.lit(f"{field}: "), v))

    return F.concat(*map(of, LEGAL_FIELDS))


UNREADABLE = "<UNREADABLE>"


def verdict(output: Column, candidates: Column, most_edits: int = 3) -> Column:
    """What becomes of an arbiter's text: struct of text, source, rejected, hitl_flag, warnings."""
    none = F.array().cast("array<string>")
    of = lambda text, source, rejected, flag, warnings: F.struct(text.alias("text"), F.lit(source).alias("source"), F.lit(rejected).alias("rejected"), F.lit(flag).alias("hitl_flag"), warnings.alias("warnings"))
    null = F.lit(None).cast("string")
    return (
        F.when(output.isNull(), of(null, "hitl_fallback", True, True, none))
        .when(F.contains(output, F.lit(UNREADABLE)), of(F.lit(""), "llm_unreadable", False, True, none))
        .when(~within_edits(output, candidates, most_edits), of(null, "rejected_edit_distance", True, True, none))
        .when(inserts_run(output, candidates), of(null, "rejected_insertion", True, True, none))
        .otherwise(of(output, "arbitration", False, False, invented_values(output, candidates)))
    )


def anonymous(engine_texts: Column) -> Column:
    """Candidates under letters instead of engines, in order of engine: array of struct(label, text)."""
    ordered = F.array_sort(engine_texts)
    return F.transform(ordered, lambda e, i: F.struct(F.char(F.lit(65) + i).alias("label"), e["text"].alias("text")))


def candidate_block(candidates: Column) -> Column:
    return F.array_join(F.transform(candidates, lambda c: F.concat(F.lit("Candidate "), c["label"], F.lit(": "), c["text"])), "\n")


# --- Markdown ---------------------------------------------------------------------------------------------------------


def pipe_table(text: Column, separator: str = "\t") -> Column:
    """Rows of separated cells as a pipe table: the text stripped, blank rows dropped, short rows filled up, the first row as head."""
    rows = F.filter(F.split(strip(text), "\n"), lambda r: strip(r) != "")
    cells = F.transform(rows, lambda r: F.transform(F.split(r, separator), strip))
    width = F.array_max(F.transform(cells, lambda r: F.size(r)))
    full = F.transform(cells, lambda r: F.concat(r, F.array_repeat(F.lit(""), (width - F.size(r)).cast("int"))))
    lines = F.transform(full, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width.cast("int")), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.size(lines))), "\n")).otherwise("")


# What is taken out of embedded graphics.
SCRIPTS, HANDLERS = r"(?is)<script[^>]*>.*?</script>", (r'\s+on\w+\s*=\s*"[^"]*"', r"\s+on\w+\s*=\s*'[^']*'")


def clean_svg(text: Column) -> Column:
    """Without script blocks and quoted event handlers."""
    out = F.regexp_replace(text, SCRIPTS, "")
    for handler in HANDLERS:
        out = F.regexp_replace(out, handler, "")
    return out


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def places(c: Column, n: int) -> Column:
    """A number that isn't negative with ``n`` (1 or 2) decimals, rounded by its exact binary value, ties to even, as C does; the JVM's formatting goes by the shortest decimal text instead.

    The fraction is taken apart in whole numbers of 64 bits: small fractions at a finer scale, so no bit of one that could be a tie is lost."""
    ten = 10**n

    def scaled(v: Column) -> Column:
        part = v - F.floor(v)
        of = lambda bits: F.struct(F.floor(v).alias("whole"), (F.floor(part * float(2**bits)).cast("long") * ten).alias("x"), F.lit(2**bits).alias("unit"))
        return F.when(part >= 1 / 16, of(56)).otherwise(of(60))

    def digits(z: Column) -> Column:
        """The whole part and the rounded decimals as one number of units of the last place."""
        k, half = z["q"], F.shiftright(z["unit"], 1)
        rest = z["x"] - k * z["unit"]
        return z["whole"] * ten + k + ((rest > half) | ((rest == half) & (k % 2 == 1))).cast("long")

    quotient = lambda z: F.struct(z["whole"].alias("whole"), z["x"].alias("x"), z["unit"].alias("unit"), F.when(z["unit"] == 2**56, F.shiftright(z["x"], 56)).otherwise(F.shiftright(z["x"], 60)).alias("q"))
    show = lambda u: F.concat(F.floor(u / ten).cast("string"), F.lit("."), F.lpad((u % ten).cast("string"), n, "0"))
    return let(let(let(let(c, scaled), quotient), digits), show)


def latex_valid(text: Column) -> Column:
    """Not blank, with an even number of ``$$`` and of the other ``$``."""
    doubles = (F.length(text) - F.length(F.replace(text, F.lit("$$"), F.lit("")))) / 2
    rest = F.replace(text, F.lit("$$"), F.lit(""))
    singles = F.length(rest) - F.length(F.replace(rest, F.lit("$"), F.lit("")))
    return F.coalesce((strip(text) != "") & (doubles % 2 == 0) & (singles % 2 == 0), F.lit(False))
