"""Problem 6: repairing text from scanned pages.

Lines are labelled by a hidden Markov model (body, break: the last line of a paragraph, running header, page number) whose
observations are layout features: place in the region, shape, an attached number, how the line ends, and on how many pages
of the volume and in how many volumes the same line stands. The model starts from weak expectations and is fitted by
expectation-maximisation over the line sequences, which are first aggregated to patterns of features, so an iteration
doesn't read the texts again. Words are joined and corrected only on lines labelled as text, and paragraphs end at breaks.

Words: letters that recognisers confuse are mapped to common classes ("skeletons", one with and one without classes of
several letters). A word is misread if a word of the same skeleton is ``DOMINANCE`` times as frequent in the corpus. Parts
of a word broken at a line end are joined without the hyphen unless the compound with the hyphen is the more frequent.

What the labelling needs of the corpus (misread words, compounds, recurring lines) is joined to the rows it concerns;
only where it is small (``BOUND`` entries, checked) it is sent along with the code instead.

Defined results: null and empty texts have no lines and give no rows; repeated rows are labelled each; a text without any
line end can have a header, a page number or a misread word, but no hyphen; the last line of a text has no hyphen row.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.lookalike import fixed_forms
from palimpsest.plans.runtime import materialise, small_rows

DOMINANCE = 12
BOUND = 400_000
ITERATIONS = 5

HYPHENS = "-\u2010\u2011\xad\xac"
_WORD = re.compile(r"[^\W_]+(?:!+[^\W_]+)*")
_COMPOUND = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[-‐‑][^\W\d_]++)+")
_LOWER = re.compile(r"(?<![^\W_!])[a-z][^\W_]{3}")
_DIGITS = re.compile(r"\d+")
_ATTACHED = re.compile(r"^(?:\d{1,4}|[ivxlc]{1,11})\s{2,}(?=\S)|(?<=\S)\s{2,}(?:\d{1,4}|[ivxlc]{1,11})$")
_ROMAN = re.compile(r"c{0,3}(?:x[lc]|l?x{0,3})(?:i[xv]|v?i{0,3})$")
_AROUND = "[({<|*~·•.=–—- \t])}>"
_NUMBER = re.compile(r"[\[({<|*~·•.=–—\-\s]*(?:(page|pag|seite|pg|p|s)\b\.?\s*)?([\w!]{1,11})(?:\s*(?:of|/|von|de)\s*([\w!]{1,11}))?[\])}>|*~·•=–—\-\s]*", re.I)

# Letters and groups of letters that recognisers confuse, with the common class on the right.
GROUPS = (("rn", "m"), ("ri", "n"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("lo", "b"), ("τι", "π"))
LETTERS = str.maketrans({"c": "e", "a": "n", "f": "t", "!": "i", "1": "i", "l": "i", "0": "o", "5": "s", "b": "h", "q": "g", "ü": "u", "é": "6", "ß": "h", "н": "и", "г": "т", "υ": "v", "л": "п"})


@lru_cache(1)
def _forms() -> tuple[dict[int, str | None], re.Pattern, re.Pattern]:
    """One-for-one replacements by the consistent forms of problem 1, a pattern of what is replaced, and one of marks that need composing."""
    one = {ord(c): to or None for c, to in fixed_forms().items()}
    return one, re.compile("[" + "".join(re.escape(chr(n)) for n in one) + "]"), re.compile("[\u0300-\u036f\u3099\u309a]")


def plain_form(text: str) -> str:
    """A text in the consistent form, with the same line ends."""
    if text.isascii():
        return text
    one, odd, marks = _forms()
    if odd.search(text):
        text = text.translate(one)
    return ud.normalize("NFC", text) if marks.search(text) else text


@lru_cache(400_000)
def skeletons(word: str) -> tuple[str, str]:
    """Skeleton with groups of letters, and without."""
    plain = word.translate(LETTERS)
    for a, b in GROUPS * 2:  # a group may come of another one
        if a in word:
            word = word.replace(a, b)
    return word.translate(LETTERS), plain


def _value(t: str) -> bool:
    """Whether a word is a number in digits or Roman, perhaps misread."""
    t = t.lower()
    if t.translate(_AS_DIGITS).isdigit():
        return any(c.isdigit() for c in t) and len(t) <= 5
    return bool(t) and bool(_ROMAN.match(t.translate(_AS_ROMAN)))


_AS_DIGITS, _AS_ROMAN = str.maketrans("ol!isé", "011156"), str.maketrans("1!", "li")
#: The most words of a page-number line: page, number, of, number.
NUMBER_WORDS = 4


def is_number(line: str) -> bool:
    """Whether a line holds only a page number, in digits or Roman, in some of its decorations, perhaps misread."""
    if len(line) > 24:  # long decorations or wide blanks round few words
        words = line.strip(_AROUND).split(None, NUMBER_WORDS)
        if len(words) > NUMBER_WORDS:
            return False
    m = _NUMBER.fullmatch(line)
    return bool(m) and _value(m[2]) and (m[3] is None or _value(m[3]))


def header_key(line: str) -> str | None:
    """What recurs of a line shaped like a running header, of any length: its skeleton without the page number; None for other lines."""
    line = line.strip()
    core = _ATTACHED.sub("", line) if "  " in line or "\t" in line else line
    # a longer word in lower case can't be in one
    if _LOWER.search(core) or core[-1:] in ".!?;:," or any(c in core for c in "|=\\^{<"):
        return None
    names = [w for w in _WORD.findall(core) if not w.isdigit()]
    # more figures than letters make a list or a table
    if len(names) < 2 or sum(map(len, _DIGITS.findall(core))) * 2 > sum(map(len, names)) or not (core.isupper() or all(w[0].isupper() or len(w) < 4 for w in names)):
        return None
    return skeletons(_DIGITS.sub("#", "".join(_WORD.findall(core.lower()))))[0]


def _runs_on(line: str) -> bool:
    """Whether a line begins in lower case, behind an attached page number if it has one."""
    if not line[:1].islower():
        return False
    m = _ATTACHED.match(line) if line[0] in "ivxlc" else None
    return m is None or line[m.end()].islower()


def near(key: str) -> Iterator[str]:
    """A key and what is left of it without any one character: keys one edit apart have one of these in common."""
    yield key
    for i in range(len(key)):
        yield key[:i] + key[i + 1 :]


class Text:
    """The analysed lines of one text."""

    __slots__ = ("keys", "lines", "low", "numbers", "pairs")

    def __init__(self, text: str) -> None:
        form = plain_form(text)
        self.low = form.lower()
        self.lines = form.split("\n")
        self.pairs: dict[int, tuple[str, str]] = {}
        raw = self.lines if form is text else text.split("\n")
        for i, x in enumerate(raw[:-1]):
            x = x.rstrip()
            if x[-1:] in HYPHENS and x[-2:-1].isalpha():
                found, then = _WORD.findall(self.lines[i].lower()), _WORD.match(self.lines[i + 1].lstrip().lower())
                if found and then and then[0][0].isalpha():
                    self.pairs[i] = (found[-1], then[0])
        self.numbers = [is_number(x) for x in self.lines]
        self.keys = [None if n or _runs_on(x) or x[-1:] in ".,;" else header_key(x) for x, n in zip(self.lines, self.numbers)]

    def count_words(self, counts: Counter) -> None:
        """Adds whole words, without the parts of broken ones."""
        counts.update(_WORD.findall(self.low))
        for p in self.pairs.values():
            counts.subtract(p)

    def compounds(self) -> list[str]:
        return _COMPOUND.findall(self.low) if "-" in self.low or "‐" in self.low else []

    def tokens(self) -> list[list[str]]:
        return [_WORD.findall(x.lower()) for x in self.lines]


STATES = ("body", "break", "header", "number")
BODY, BREAK, HEADER, NUMBER = range(len(STATES))
#: Features of a line: name -> number of values. shape: none, title case of few words, of many, capitals of few words, of many;
#: recurs: not, a little, on many pages of the volume, in many volumes; end: the line goes on, a sentence ends with it, and
#: it is much shorter than the widest, nothing or a row of a table.
FEATURES = {"place": 4, "shape": 5, "number": 2, "attached": 2, "recurs": 4, "end": 4}
FEW_WORDS = 6
SHORT = 0.6
#: A line recurs much in a volume if it stands on this share of its pages. It recurs much in all if it is in several volumes
#: and comes back inside them: on this many further pages a volume, ``DOUBT`` volumes without any added. So neither depends
#: on how many volumes there are.
SHARE, REPEATS, DOUBT = 0.003, 0.25, 4


def features(text: Text, support: Callable[[str], tuple[int, int]] | None) -> list[tuple[int, ...]]:
    lines = text.lines
    out, n = [], len(lines)
    width = SHORT * max(map(len, lines))
    for i, (x, key, number) in enumerate(zip(lines, text.keys, text.numbers)):
        place = 0 if n == 1 else 1 if i == 0 else 2 if i == n - 1 else 3
        recurs, shape, attached, end = 0, 0, 0, 0
        if key:
            pages, volumes = support(key) if support else (0, 0)
            recurs = 3 if volumes > 1 else 2 if pages > 1 else int(pages + volumes > 0)
            attached = int(bool(_ATTACHED.search(x.strip())))
            few = len(_WORD.findall(x)) <= FEW_WORDS + attached
            shape = (3 if x.isupper() else 1) + (not few)
        last = x.rstrip()[-1:]
        if not last or "|" in x:
            end = 3
        elif last in ".!?:。！？”»" and not (i + 1 < n and lines[i + 1][:1].islower()):
            end = 2 if len(x) < width else 1
        out.append((place, shape, int(number), attached, recurs, end))
    return out


class Layout:
    """The hidden Markov model over the lines of a text, with independent features; many sequences at once."""

    def __init__(self) -> None:
        self.start = np.array([0.6, 0.25, 0.1, 0.05])
        self.step = np.array([[0.7, 0.25, 0.01, 0.04], [0.7, 0.25, 0.01, 0.04], [0.75, 0.2, 0.01, 0.04], [0.75, 0.2, 0.03, 0.02]])
        text = {"place": [0.25] * 4, "shape": [0.92, 0.01, 0.005, 0.015, 0.05], "number": [0.999, 0.001], "attached": [0.998, 0.002], "recurs": [0.97, 0.02, 0.008, 0.002]}
        emit = [
            text | {"end": [0.87, 0.11, 0.01, 0.01]},
            text | {"end": [0.03, 0.17, 0.6, 0.2]},
            {"place": [0.35, 0.6, 0.03, 0.02], "shape": [0.004, 0.6, 0.01, 0.376, 0.01], "number": [0.999, 0.001], "attached": [0.6, 0.4], "recurs": [0.001, 0.049, 0.15, 0.8], "end": [0.7, 0.08, 0.18, 0.04]},
            {"place": [0.4, 0.1, 0.48, 0.02], "shape": [0.996, 0.001, 0.001, 0.001, 0.001], "number": [0.01, 0.99], "attached": [0.999, 0.001], "recurs": [0.997, 0.001, 0.001, 0.001], "end": [0.7, 0.08, 0.18, 0.04]},
        ]
        self.emit = {f: np.array([e[f] for e in emit]) for f in FEATURES}

    def expect(self, seqs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of the states per line, and the expected transitions, by scaled forward-backward; ``seqs``: sequences of one length, their lines, features."""
        like = np.ones((*seqs.shape[:2], len(STATES)))
        for k, e in enumerate(self.emit.values()):
            like *= e.T[seqs[:, :, k]]
        n = seqs.shape[1]
        fwd, back = np.empty_like(like), np.ones_like(like)
        scaled = lambda x: x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300)
        fwd[:, 0] = scaled(like[:, 0] * self.start)
        for t in range(1, n):
            fwd[:, t] = scaled(like[:, t] * (fwd[:, t - 1] @ self.step))
        moves = np.zeros((len(seqs), len(STATES), len(STATES)))
        for t in range(n - 2, -1, -1):
            ahead = like[:, t + 1] * back[:, t + 1]
            back[:, t] = scaled(ahead @ self.step.T)
            both = fwd[:, t, :, None] * self.step * ahead[:, None, :]
            moves += both / np.maximum(both.sum(axis=(1, 2), keepdims=True), 1e-300)
        return scaled(fwd * back), moves

    def labels(self, codes: Iterable[str]) -> dict[str, list[int]]:
        """The most likely state of every line, by code of the sequence."""
        out: dict[str, list[int]] = {}
        for own, seqs in _decoded(codes):
            out.update(zip(own, self.expect(seqs)[0].argmax(axis=2).tolist()))
        return out


def _code(seq: list[tuple[int, ...]]) -> str:
    return " ".join(["".join(map(str, x)) for x in seq])


def _decoded(codes: Iterable[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Codes of equal length with their sequences."""
    of: dict[int, list[str]] = defaultdict(list)
    for c in codes:
        of[len(c)].append(c)
    for own in of.values():
        digits = np.frombuffer("".join(own).replace(" ", "").encode(), dtype=np.uint8) - 48
        yield own, digits.reshape(len(own), -1, len(FEATURES))


def fit_layout(patterns: DataFrame, iterations: int = ITERATIONS) -> Layout:
    """Expectation-maximisation over ``pattern string, n long``; per iteration the driver gets a row per parameter of the model (at most 110)."""
    model, first = Layout(), Layout()
    states = range(len(STATES))
    for _ in range(iterations):

        def run(batches: Iterator[pd.DataFrame], model: Layout = model) -> Iterator[pd.DataFrame]:
            sums: Counter = Counter()
            for pdf in batches:
                times = dict(zip(pdf["pattern"], pdf["n"]))
                for own, seqs in _decoded(times):
                    n = np.array([times[c] for c in own], dtype=float)
                    post, moves = model.expect(seqs)
                    post *= n[:, None, None]
                    begun, gone = post[:, 0].sum(axis=0), (moves * n[:, None, None]).sum(axis=0)
                    for s in states:
                        sums["start", s, "", 0] += begun[s]
                        for j in states:
                            sums["step", s, "", j] += gone[s, j]
                        for k, (f, size) in enumerate(FEATURES.items()):
                            for v, x in enumerate(np.bincount(seqs[:, :, k].ravel(), weights=post[:, :, s].ravel(), minlength=size)):
                                sums["emit", s, f, v] += x
            yield pd.DataFrame([(*k, float(v)) for k, v in sums.items()], columns=["what", "s", "f", "v", "n"])

        rows = patterns.mapInPandas(run, "what string, s int, f string, v int, n double").groupBy("what", "s", "f", "v").agg(F.sum("n").alias("n")).collect()
        got = {(r["what"], r["s"], r["f"], r["v"]): r["n"] for r in rows}
        old, model = model, Layout()
        count = lambda *ks: np.array([got.get(k, 0.0) for k in ks])
        share = lambda xs, before: (xs + 0.2 * (xs.sum() + 50) * before) / (1.2 * xs.sum() + 10)  # noqa: E731  # what was expected counts as a fifth of the lines
        model.start = share(count(*[("start", s, "", 0) for s in states]), first.start)
        model.step = np.array([share(count(*[("step", s, "", j) for j in states]), first.step[s]) for s in states])
        model.emit = {f: np.array([share(count(*[("emit", s, f, v) for v in range(k)]), first.emit[f][s]) for s in states]) for f, k in FEATURES.items()}
        # a running header recurs and a break ends short of the width by definition, so that isn't learned
        model.emit["recurs"][HEADER], model.emit["end"][BREAK] = first.emit["recurs"][HEADER], first.emit["end"][BREAK]
        if np.abs(old.step - model.step).max() < 1e-4:
            break
    return model


def texts(regions: DataFrame, aligned: DataFrame) -> DataFrame:
    """Both text columns as (field, row_key, doc_id, page_num, text), without null and empty texts."""
    a = regions.select(F.lit("text_content").alias("field"), F.col("region_key").alias("row_key"), "doc_id", "page_num", F.col("text_content").alias("text"))
    b = aligned.select(F.lit("consensus_text").alias("field"), F.col("aligned_key").alias("row_key"), "doc_id", "page_num", F.col("consensus_text").alias("text"))
    return a.unionByName(b).filter("text != ''")


def _statistics(rows: DataFrame) -> DataFrame:
    """Words, compounds and broken pairs with their counts, and header-like lines with volume and page; combined per batch, where copies of a text are analysed once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, Counter] = defaultdict(Counter)
        words: dict[int, Counter] = defaultdict(Counter)  # by the number of copies
        places: set[tuple[str, int, int]] = set()
        keyed: Counter = Counter()
        for pdf in batches:
            done: dict[str, tuple[str, list[str]]] = {}
            for text, n in Counter(pdf["text"]).items():
                t = Text(text)
                t.count_words(words[n])
                for c in t.compounds():
                    counts["c"][c] += n
                for p in t.pairs.values():
                    counts["p"][" ".join(p)] += n
                code = _code(features(t, None))
                if any(t.keys):
                    done[text] = "\t".join([code, *(k or "" for k in t.keys)]), [k for k in t.keys if k]
                else:
                    counts["f"][code] += n
            if done:
                for text, d, p in zip(pdf["text"], pdf["doc_id"], pdf["page_num"]):
                    got = done.get(text)
                    if got:
                        keyed[got[0], d] += 1
                        places.update((k, d, p) for k in got[1])
            if sum(map(len, counts.values())) + sum(map(len, words.values())) + len(places) > 500_000:
                yield _rows(counts, words, places, keyed)
                for x in (counts, words, places, keyed):
                    x.clear()
        yield _rows(counts, words, places, keyed)

    def _rows(counts: dict[str, Counter], words: dict[int, Counter], places: set, keyed: Counter) -> pd.DataFrame:
        out = [(k, x, n, None, None) for k, c in counts.items() for x, n in c.items()]
        out += [("w", x, times * n, None, None) for times, c in words.items() for x, n in c.items() if n and not x.isdigit()]
        out += [("l", k, 1, d, p) for k, d, p in places] + [("k", k, n, d, None) for (k, d), n in keyed.items()]
        return pd.DataFrame(out, columns=["kind", "what", "n", "doc_id", "page_num"])

    return rows.select("doc_id", "page_num", "text").mapInPandas(run, "kind string, what string, n long, doc_id long, page_num long")


def _with_skeletons(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [skeletons(w) for w in pdf["what"]]
            yield pdf.assign(s1=pd.Series([a for a, _ in found], dtype=object, index=pdf.index), s2=pd.Series([b for _, b in found], dtype=object, index=pdf.index))

    return words.mapInPandas(run, "what string, n long, s1 string, s2 string")


def near_ones(keys: DataFrame, strong: DataFrame) -> DataFrame:
    """(key, like): keys that are one edit away from a strong one, with the first of those; by what is left of both without a character."""
    few = small_rows(strong, BOUND // 50)
    if few is not None:
        of: dict[str, str] = {}
        for k in sorted(r["key"] for r in few):
            for v in near(k):
                of.setdefault(v, k)
        sent = keys.sparkSession.sparkContext.broadcast(of)

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            of = sent.value
            for pdf in batches:
                found = [(k, min((of[v] for v in near(k) if v in of), default=None)) for k in pdf["key"]]
                yield pd.DataFrame([x for x in found if x[1] is not None], columns=["key", "like"])

        return keys.mapInPandas(look, "key string, like string")

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, v) for k in pdf["key"] for v in dict.fromkeys(near(k))], columns=["key", "v"])

    split = lambda d: d.mapInPandas(parts, "key string, v string")
    return split(keys).join(split(strong).groupBy("v").agg(F.min("key").alias("like")), "v").groupBy("key").agg(F.min("like").alias("like"))


class Knowledge:
    """Tables the labelling looks up: misread (what -> top), compounds (pairs that keep the hyphen), lines (key, doc_id -> pages, volumes)."""

    def __init__(self, rows: DataFrame) -> None:
        self.found = found = materialise(_statistics(rows).groupBy("kind", "what", "doc_id", "page_num").agg(F.sum("n").alias("n")), "p6-statistics")
        words = found.filter("kind = 'w' and n > 0").select("what", "n")
        pairs = found.filter("kind = 'p'").select(F.split("what", " ").alias("ab"), "n").select(F.col("ab")[0].alias("a"), F.col("ab")[1].alias("b"))
        # words put together from broken ones are looked at as words that occur nowhere else
        known = _with_skeletons(words.unionByName(pairs.select(F.concat("a", "b").alias("what"), F.lit(0).cast("long").alias("n"))).groupBy("what").agg(F.sum("n").alias("n")))
        known = materialise(known, "p6-words")
        tops = [known.filter("n > 0").groupBy(s).agg(F.max(F.struct("n", "what")).alias("t")).select(s, F.col("t.n").alias(f"n_{s}"), F.col("t.what").alias(f"t_{s}")) for s in ("s1", "s2")]
        judged = known.join(tops[0], "s1", "left").join(tops[1], "s2", "left")
        judged = judged.withColumn("top", F.when(F.coalesce("n_s1", F.lit(0)) >= F.coalesce("n_s2", F.lit(0)), F.col("t_s1")).otherwise(F.col("t_s2"))).withColumn("most", F.greatest("n_s1", "n_s2"))
        # short words and such with more figures than letters are no evidence
        letters = F.length(F.regexp_replace("what", r"[\d!]", ""))
        self.misread = judged.filter((F.length("what") > 2) & (letters * 2 > F.length("what")) & ~F.col("top").rlike(r"[\d!]") & (F.col("what") != F.col("top")) & (F.col("most") >= DOMINANCE * F.greatest("n", F.lit(1)))).select("what", "top")
        # a pair keeps its hyphen where the compound is written on one line more often than the joined word
        compounds = _with_skeletons(found.filter("kind = 'c'").select("what", "n")).groupBy("s1").agg(F.sum("n").alias("kept"))
        joined = known.groupBy("s1").agg(F.sum("n").alias("joined"))
        forms = _with_skeletons(pairs.select(F.concat_ws("-", "a", "b").alias("what"), F.lit(0).cast("long").alias("n"))).select(F.split("what", "-").alias("ab"), F.col("s1").alias("sc")).select(F.col("ab")[0].alias("a"), F.col("ab")[1].alias("b"), "sc", F.concat(F.col("ab")[0], F.col("ab")[1]).alias("what"))
        alone = lambda c: known.select(F.col("what").alias(c), F.col("n").alias(f"n_{c}"))
        judged = forms.join(compounds.withColumnRenamed("s1", "sc"), "sc", "left").join(known.select("what", "s1"), "what", "left").join(joined, "s1", "left").join(alone("a"), "a", "left").join(alone("b"), "b", "left")
        kept, whole = F.coalesce("kept", F.lit(0)), F.coalesce("joined", F.lit(0))
        # where neither is known, both parts being words of their own speaks for a hyphen that stays ("pre- / and post-war")
        own = (F.coalesce("n_a", F.lit(0)) > 0) & (F.coalesce("n_b", F.lit(0)) >= 20)
        self.compounds = judged.filter((kept > whole) | ((kept + whole == 0) & own)).select("a", "b")
        lines = found.filter("kind = 'l'").select(F.col("what").alias("key"), "doc_id", "page_num").distinct()
        pages = lines.groupBy("key", "doc_id").agg(F.count("*").alias("pages"))
        volumes = pages.groupBy("key").agg(F.count("*").alias("volumes"), F.sum("pages").alias("on"))
        of = rows.select("doc_id", "page_num").distinct().groupBy("doc_id").agg(F.count("*").alias("all_pages"))
        # only lines that recur at all need looking up; how much, is 1 for a small share and 2 for a large one
        volumes = volumes.withColumn("strong", (F.col("volumes") > 1) & (F.col("on") - F.col("volumes") >= REPEATS * (F.col("volumes") + DOUBT)))
        some = lambda n, much: F.when(F.col(n) > 1, F.when(much, 2).otherwise(1)).otherwise(0).cast("long").alias(n)
        base = pages.join(volumes, "key").filter("pages > 1 or volumes > 1").join(of, "doc_id").select("key", "doc_id", some("pages", F.col("pages") / F.col("all_pages") >= SHARE), some("volumes", F.col("strong")))
        base = materialise(base, "p6-recurring")
        # a line one edit away from one of many volumes counts as that one
        strong = volumes.filter("strong").select("key")
        like = materialise(near_ones(volumes.select("key").join(strong, "key", "left_anti"), strong), "p6-like")
        theirs = base.select(F.col("key").alias("like"), "doc_id", F.col("pages").alias("their_pages"))
        liked = pages.select("key", "doc_id").join(like, "key").join(base, ["key", "doc_id"], "left").join(theirs, ["like", "doc_id"], "left")
        liked = liked.select("key", "doc_id", F.coalesce(F.greatest("pages", "their_pages"), F.lit(0)).alias("pages"), F.lit(2).cast("long").alias("volumes"))
        self.lines = base.join(like.select("key"), "key", "left_anti").unionByName(liked)
        self.misread, self.compounds, self.lines = (materialise(x, f"p6-{n}") for n, x in (("misread", self.misread.distinct()), ("compounds", self.compounds.distinct()), ("lines", self.lines)))


Lookup = tuple[dict[str, str], set[tuple[str, str]], dict[tuple[str, int], tuple[int, int]]]


def _labelled(texts: list[Text], docs: list[int], looks: list[Lookup], model: Layout, all_lines: bool) -> list[list[int] | None]:
    """States of the lines of every text, all texts at once; None where nothing but text can come out and only that is asked."""
    codes = [_code(features(t, lambda k, d=d, lines=look[2]: lines.get((k, d), (0, 0)))) if all_lines or any(t.keys) or any(t.numbers) else None for t, d, look in zip(texts, docs, looks)]
    states = model.labels({c for c in codes if c})
    return [states[c] if c else None for c in codes]


def _each(rows: DataFrame, known: Knowledge, model: Layout, schema: str, make: Callable[[Text, Lookup, list[int] | None], list[tuple]], all_lines: bool = False) -> DataFrame:
    """Apply ``make`` to every row with its labels and what it has to look up: sent with the code if small, else joined to each row."""
    misread, compounds, lines = (small_rows(x, BOUND) for x in (known.misread, known.compounds, known.lines))
    columns = [c.split()[0] for c in schema.split(", ")]

    if misread is not None and compounds is not None and lines is not None:
        lookup = rows.sparkSession.sparkContext.broadcast(({r[0]: r[1] for r in misread}, {(r[0], r[1]) for r in compounds}, {(r["key"], r["doc_id"]): (r["pages"], r["volumes"]) for r in lines}))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            look = lookup.value
            for pdf in batches:
                analysed = {x: Text(x) for x in dict.fromkeys(pdf["text"])}
                # a text without lines that may recur is the same in every volume
                at = [(x, d if any(analysed[x].keys) else None) for x, d in zip(pdf["text"], pdf["doc_id"])]
                each = list(dict.fromkeys(at))
                own = [analysed[x] for x, _ in each]
                states = _labelled(own, [d for _, d in each], [look] * len(each), model, all_lines)
                done = {k: make(t, look, l) for k, t, l in zip(each, own, states)}
                yield pd.DataFrame([(field, key, *x) for field, key, k in zip(pdf["field"], pdf["row_key"], at) for x in done[k]], columns=columns)

        return rows.select("field", "row_key", "doc_id", "text").mapInPandas(run, schema)

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, doc, text in zip(pdf["rid"], pdf["doc_id"], pdf["text"]):
                t = Text(text)
                out += [(i, "w", w, "", doc) for w in {*_WORD.findall(t.low), *(a + b for a, b in t.pairs.values())}] + [(i, "p", a, b, doc) for a, b in set(t.pairs.values())] + [(i, "l", k, "", doc) for k in set(t.keys) if k]
            yield pd.DataFrame(out, columns=["rid", "kind", "a", "b", "doc_id"])

    stored = materialise(rows.withColumn("rid", F.monotonically_increasing_id()), "p6-rows")
    asked = materialise(stored.select("rid", "doc_id", "text").mapInPandas(wanted, "rid long, kind string, a string, b string, doc_id long"), "p6-asked")
    none = F.lit(None)
    answers = asked.filter("kind = 'w'").join(known.misread.withColumnRenamed("what", "a"), "a").select("rid", "kind", "a", F.col("top").alias("b"), none.cast("long").alias("x"), none.cast("long").alias("y"))
    answers = answers.unionByName(asked.filter("kind = 'p'").join(known.compounds, ["a", "b"]).select("rid", "kind", "a", "b", none.cast("long").alias("x"), none.cast("long").alias("y")))
    answers = answers.unionByName(asked.filter("kind = 'l'").join(known.lines.withColumnRenamed("key", "a"), ["a", "doc_id"]).select("rid", "kind", "a", "b", F.col("pages").alias("x"), F.col("volumes").alias("y")))
    per_row = stored.join(answers.groupBy("rid").agg(F.collect_list(F.struct("kind", "a", "b", "x", "y")).alias("answers")), "rid", "left")

    def run_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own, docs, looks = [*map(Text, pdf["text"])], [*pdf["doc_id"]], []
            for doc, got in zip(docs, pdf["answers"]):
                got = got if got is not None else []
                looks.append(({r["a"]: r["b"] for r in got if r["kind"] == "w"}, {(r["a"], r["b"]) for r in got if r["kind"] == "p"}, {(r["a"], doc): (r["x"], r["y"]) for r in got if r["kind"] == "l"}))
            states = _labelled(own, docs, looks, model, all_lines)
            yield pd.DataFrame([(field, key, *x) for field, key, t, look, l in zip(pdf["field"], pdf["row_key"], own, looks, states) for x in make(t, look, l)], columns=columns)

    return per_row.mapInPandas(run_joined, schema)


def noise_of(t: Text, look: Lookup, labels: list[int] | None) -> list[tuple[str, int]]:
    """(noise_kind, line_no) of one text; words are judged on lines of text only."""
    misread, compounds = look[:2]
    aside = {i: "running_header" if l == HEADER else "page_number" for i, l in enumerate(labels) if l >= HEADER} if labels else {}
    out: list[tuple[str, int]] = [(kind, i) for i, kind in aside.items()]
    bad: set[int] = set()
    if not misread.keys().isdisjoint(_WORD.findall(t.low)):
        for i, ts in enumerate(t.tokens()):
            lo, hi = int(i - 1 in t.pairs), len(ts) - (i in t.pairs)
            if any(w in misread for w in ts[lo:hi]):
                bad.add(i)
    for i, (a, b) in t.pairs.items():
        if i in aside:
            continue
        if (a, b) in compounds:
            bad |= {i} if a in misread else set()
            bad |= {i + 1} if b in misread else set()
            continue
        out.append(("hyphen", i))
        top = misread.get(a + b)
        if top:
            same = next((k for k, (x, y) in enumerate(zip(a + b, top)) if x != y), min(len(a + b), len(top)))
            bad.add(i if same < len(a) else i + 1)
    return out + [("misread", i) for i in sorted(bad) if i not in aside]


def paragraphs_of(t: Text, look: Lookup, labels: list[int]) -> list[str]:
    """The text as paragraphs: no headers and page numbers, words joined and corrected, lines run together up to each break."""
    misread, compounds = look[:2]
    fix = lambda m: _recased(m[0], misread[m[0].lower()]) if m[0].lower() in misread else m[0]
    out, held = [], ""
    for i, (x, l) in enumerate(zip(t.lines, labels)):
        if l >= HEADER:
            continue
        x = x.strip()
        if i in t.pairs and t.pairs[i] not in compounds:
            held += x.rstrip("-‐‑­¬ ")
            continue
        held += x
        if i in t.pairs:
            continue
        if l == BREAK or not x:
            out.append(_WORD.sub(fix, held))
            held = ""
        else:
            held += " "
    return [p.strip() for p in [*out, _WORD.sub(fix, held)] if p.strip()]


def _recased(was: str, word: str) -> str:
    return word.upper() if was.isupper() and len(was) > 1 else word[0].upper() + word[1:] if was[:1].isupper() else word


def fitted(rows: DataFrame) -> tuple[Knowledge, Layout]:
    known = Knowledge(rows)
    # patterns of lines; those with lines that may recur get to know whether they do
    keyed = known.found.filter("kind = 'k'").select("what", "doc_id", "n").withColumn("rid", F.monotonically_increasing_id())
    keyed = materialise(keyed.withColumn("keys", F.split("what", "\t")).drop("what"), "p6-keyed")
    asked = keyed.select("rid", "doc_id", F.explode(F.array_distinct(F.slice("keys", 2, F.size("keys")))).alias("key")).filter("key != ''")
    met = asked.join(known.lines, ["key", "doc_id"]).groupBy("rid").agg(F.collect_list(F.struct("key", "pages", "volumes")).alias("met"))

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = [*FEATURES].index("recurs")
        for pdf in batches:
            out = []
            for keys, n, met in zip(pdf["keys"], pdf["n"], pdf["met"]):
                got = {m["key"]: "3" if m["volumes"] > 1 else "2" if m["pages"] > 1 else str(int(m["pages"] + m["volumes"] > 0)) for m in (met if met is not None else [])}
                out.append((" ".join([x[:at] + got.get(k, "0") + x[at + 1 :] for x, k in zip(keys[0].split(" "), keys[1:])]), n))
            yield pd.DataFrame(out, columns=["pattern", "n"])

    recurring = keyed.join(met, "rid", "left").select("keys", "n", "met").mapInPandas(resolve, "pattern string, n long")
    plain = known.found.filter("kind = 'f'").select(F.col("what").alias("pattern"), "n")
    return known, fit_layout(materialise(recurring.unionByName(plain).groupBy("pattern").agg(F.sum("n").alias("n")), "p6-patterns"))


def noise(regions: DataFrame, aligned: DataFrame) -> DataFrame:
    """(field, row_key, noise_kind, line_no)."""
    rows = texts(regions, aligned)
    known, model = fitted(rows)
    return _each(rows, known, model, "field string, row_key long, noise_kind string, line_no int", noise_of)


def repaired(regions: DataFrame, aligned: DataFrame) -> DataFrame:
    """(field, row_key, paragraph_no, paragraph)."""
    rows = texts(regions, aligned)
    known, model = fitted(rows)
    return _each(rows, known, model, "field string, row_key long, paragraph_no int, paragraph string", lambda t, look, labels: list(enumerate(paragraphs_of(t, look, labels))), all_lines=True)
