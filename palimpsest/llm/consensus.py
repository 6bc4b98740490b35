"""Problem 3: consensus of several engines' readings, agreement, and a reliability per engine.

Readings are brought to one consistent form (problem 1), split into tokens and aligned; every place where they differ
is an item that the engines labelled. A competence-and-spamming mixture explains the labels: with probability
``competence[e]`` engine ``e`` gives the true token, otherwise it draws one from its own guess distribution over kinds
of tokens (known word, unknown word, nothing, repetition). Expectation-maximisation over all items yields both and the
posterior of every candidate; the prior of a candidate follows how often its token occurs where all engines agree.

The E-step depends on an item only through the partition of the engines, the kinds and the rough prior odds, so items
are aggregated to such patterns before the iterations: each iteration reads the patterns, not the texts.

Defined results: null entries, engines and texts are left out, a region without readings has a null consensus and null
agreement, one reading is its own consensus, a tie goes to the candidate with the larger prior and then to the one given
first in engine order; repeated rows are resolved each under their own key.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.lookalike import lookalike_table, readings, rewriter
from palimpsest.plans.runtime import materialise, small_rows

KINDS = ("known", "unknown", "nothing", "repeated")
ITERATIONS = 8
_TOKEN = re.compile(r"[^\S\n]*[^\s]+|[^\S\n]*\n|[^\S\n]+")
_EDGES = re.compile(r"^\W+|[^\w²³¹½¼¾%]+$")
_DIGIT = re.compile(r"\d")
#: Counts of the words in differing labels are sent to all tasks up to this many; more are joined.
BOUND = 500_000


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


@lru_cache(300_000)
def _unit(token: str) -> str:
    return _DIGIT.sub("0", _EDGES.sub("", token))


def units(text: str) -> list[str]:
    """The tokens as they are counted: without outer punctuation and with every digit as 0."""
    return [x for x in map(_unit, text.split()) if x]


def _ends(lists: list[list[str]]) -> tuple[int, int]:
    """How many tokens all lists begin and, behind those, end with."""
    least, (first, *rest) = min(map(len, lists)), lists
    head = next((i for i in range(least) if any(x[i] != first[i] for x in rest)), least)
    tail = next((i for i in range(least - head) if any(x[-1 - i] != first[-1 - i] for x in rest)), least - head)
    return head, tail


def segments(texts: list[str]) -> list[list[str]]:
    """The aligned texts as segments in reading order: of one string where all agree, of one label per text elsewhere.

    Between what all begin and end with, all texts are aligned to the one that most agree with; spans of it that differ from
    any text are joined where they overlap, and a replacement of as many tokens as it replaces is split into single tokens."""
    if len(set(texts)) == 1:
        return [[texts[0]]]
    lists = [tokens(t) for t in texts]
    head, tail = _ends(lists)
    middles = [x[head : len(x) - tail] for x in lists]
    common, times = Counter(texts).most_common(1)[0]
    pivot = texts.index(common)
    if times == 1 and len(texts) > 2:
        alike = [0.0] * len(lists)
        for i, j in itertools.combinations(range(len(lists)), 2):
            same = head + tail + sum(m.size for m in SequenceMatcher(None, middles[i], middles[j], autojunk=False).get_matching_blocks())
            for k in (i, j):
                alike[k] += 2 * same / (len(lists[i]) + len(lists[j]))
        pivot = alike.index(max(alike))
    base = lists[pivot]
    edits: list[list[tuple[int, int, int]]] = []  # span of the base, tokens gained
    done: dict[str, list[tuple[int, int, int]]] = {texts[pivot]: []}
    for text, other in zip(texts, middles):
        mine = done.get(text)
        if mine is None:
            mine = done[text] = []
            for op, a, b, c, d in SequenceMatcher(None, middles[pivot], other, autojunk=False).get_opcodes():
                if op != "equal":
                    a, b = a + head, b + head
                    mine += [(i, i + 1, 0) for i in range(a, b)] if b - a == d - c else [(a, b, (d - c) - (b - a))]
        edits.append(mine)
    spans: list[list[int]] = []
    of: dict[tuple[int, int], int] = {}
    for a, b in sorted({(a, b) for mine in edits for a, b, _ in mine}):
        if spans and (a < spans[-1][1] or (a == spans[-1][1] and (a == b or spans[-1][0] == spans[-1][1]))):
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
        of[a, b] = len(spans) - 1
    grown = [[0] * len(spans) for _ in lists]
    for g, mine in zip(grown, edits):
        for a, b, gain in mine:
            g[of[a, b]] += gain
    out: list[list[str]] = []
    at, shift = 0, [0] * len(lists)
    for k, (a, b) in enumerate(spans):
        if a > at:
            out.append(["".join(base[at:a])])
        labels = []
        for i, other in enumerate(lists):
            labels.append("".join(other[a + shift[i] : b + shift[i] + grown[i][k]]))
            shift[i] += grown[i][k]
        out.append(labels)
        at = b
    if at < len(base):
        out.append(["".join(base[at:])])
    return out


def _repeats(label: str, around: tuple[str, str]) -> bool:
    """Whether a label says again what stands before or after it, or one token twice."""
    own = label.split()
    return bool(own) and (own == around[0].split()[-1:] or own == around[1].split()[:1] or any(x == y for x, y in itertools.pairwise(own)))


def classes(labels: list[str], counts: list[int], around: tuple[str, str]) -> dict[str, tuple[int, int]]:
    """Kind and rough count of every distinct label, in the order of first appearance."""
    out: dict[str, tuple[int, int]] = {}
    for label, n in zip(labels, counts):
        if label not in out:
            kind = 2 if not label.strip() else 3 if _repeats(label, around) else 0 if n else 1
            out[label] = (kind, int(math.log2(n + 1)) // 3 if kind < 2 else 0)
    return out


def pattern(engines: list[str], labels: list[str], found: dict[str, tuple[int, int]]) -> str:
    order = {x: i for i, x in enumerate(found)}
    return ";".join(f"{e}={order[x]}" for e, x in zip(engines, labels)) + "|" + ";".join(f"{k},{b}" for k, b in found.values())


#: Among how many tokens of its kind a guess chooses.
CHOICES = (200, 20, 1, 1)


class Model:
    """Parameters of the mixture: competence and guess distribution per engine, prior weight per class of candidate."""

    def __init__(self) -> None:
        self.competence: dict[str, float] = {}
        self.guess: dict[str, list[float]] = {}
        self.prior: dict[tuple[int, int], float] = {}

    def _weight(self, c: tuple[int, int]) -> float:
        kind, bucket = c
        return self.prior.get(c, (min(0.9, 0.6 + 0.1 * bucket), 0.2, 0.3, 0.1)[kind])

    def posterior(self, engines: list[str], said: list[int], found: list[tuple[int, int]]) -> tuple[list[float], list[float]]:
        """Probability of every candidate, and for each engine that it knew (rather than guessed)."""
        log, knew = [], []
        for c, kind in enumerate(found):
            total, own = math.log(self._weight(kind)), []
            for e, l in zip(engines, said):
                know = self.competence.get(e, 0.9) * (l == c)
                guess = (1 - self.competence.get(e, 0.9)) * self.guess.get(e, [0.25] * 4)[found[l][0]] / CHOICES[found[l][0]]
                total += math.log(know + guess + 1e-12)
                own.append(know / (know + guess + 1e-12))
            log.append(total)
            knew.append(own)
        top = max(log)
        p = [math.exp(x - top) for x in log]
        norm = sum(p)
        p = [x / norm for x in p]
        return p, [sum(pc * own[i] for pc, own in zip(p, knew)) for i in range(len(engines))]


def _read(text: str) -> tuple[list[str], list[int], list[tuple[int, int]]]:
    said, found = text.split("|")
    pairs = [x.rsplit("=", 1) for x in said.split(";")]
    return [a for a, _ in pairs], [int(b) for _, b in pairs], [tuple(map(int, x.split(","))) for x in found.split(";")]  # type: ignore[misc]


def fit(patterns: DataFrame, iterations: int = ITERATIONS) -> Model:
    """Expectation-maximisation over ``pattern string, n long``. What comes back to the driver per iteration is a row per engine and kind and a row per class of candidate (at most 4 x 22)."""
    model = Model()
    for _ in range(iterations):

        def expect(batches: Iterator[pd.DataFrame], model: Model = model) -> Iterator[pd.DataFrame]:
            sums: Counter = Counter()
            for pdf in batches:
                for text, n in zip(pdf["pattern"], pdf["n"]):
                    engines, said, found = _read(text)
                    p, knew = model.posterior(engines, said, found)
                    for e, l, k in zip(engines, said, knew):
                        sums["e", e, -1, 0] += n * k
                        sums["e", e, found[l][0], 0] += n * (1 - k)
                    if len(found) > 1:
                        for c, pc in zip(found, p):
                            sums["t", "", *c] += n * pc
                            sums["a", "", *c] += n
            yield pd.DataFrame([(*k, float(v)) for k, v in sums.items()], columns=["what", "engine", "kind", "bucket", "v"])

        rows = patterns.mapInPandas(expect, "what string, engine string, kind int, bucket int, v double").groupBy("what", "engine", "kind", "bucket").agg(F.sum("v").alias("v")).collect()
        got = {(r["what"], r["engine"], r["kind"], r["bucket"]): r["v"] for r in rows}
        model = Model()
        for e in sorted({k[1] for k in got if k[0] == "e"}):
            spam = [got.get(("e", e, k, 0), 0.0) for k in range(4)]
            known = got.get(("e", e, -1, 0), 0.0)
            model.competence[e] = (known + 9) / (known + sum(spam) + 10)
            model.guess[e] = [(x + 0.5) / (sum(spam) + 2) for x in spam]
        for (what, _, kind, bucket), v in got.items():
            if what == "a":
                share = (got.get(("t", "", kind, bucket), 0.0) + 0.5) / (v + 1)
                model.prior[kind, bucket] = share
    return model


SEGMENTS = "rid long, entries int, engines array<string>, segments array<array<string>>"


def _aligned(rows: DataFrame, key: str) -> DataFrame:
    """One row per region with its segments, and beside them rows of word counts where all readings agree."""
    table = lookalike_table(readings(rows, key), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewrite = lru_cache(50_000)(rewriter(table))
        for pdf in batches:
            out, seen, same = [], Counter(), Counter()
            done: dict[tuple[str, ...], list[list[str]]] = {(): []}
            for k, n, entries in zip(pdf[key], pdf["entries"], pdf["e"]):
                engines, texts = [e["engine"] for e in entries], tuple([rewrite(e["text"]) for e in entries])
                parts = done.get(texts)
                if parts is None:
                    parts = done[texts] = segments([*texts])
                for x in parts:
                    if len(x) == 1 or len(texts) == 1:
                        seen.update(units(x[0]))
                        if len(texts) > 1:
                            same[";".join(engines)] += x[0].count(" ") + 1
                out.append((k, n, engines, parts, None, None))
            out += [(None, None, None, None, w, n) for w, n in seen.items()]
            out += [(None, None, same_engines.split(";"), None, None, n) for same_engines, n in same.items()]
            yield pd.DataFrame(out, columns=[key, "entries", "engines", "segments", "word", "n"])

    # entries in one order whatever order they were stored in
    usable = F.array_sort(F.filter("engine_texts", lambda e: e["engine"].isNotNull() & e["text"].isNotNull()))
    pairs = rows.select(key, F.size(F.filter("engine_texts", lambda e: e.isNotNull())).alias("entries"), F.coalesce(usable, F.array()).alias("e"))
    return pairs.mapInPandas(run, f"{key} long, entries int, engines array<string>, segments array<array<string>>, word string, n long")


def _counted(regions: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, Callable[[object], dict[str, int]]]:
    """Regions that differ somewhere, and what gives the counts of the words in a row's labels: from a table sent to all tasks if it is small, else from a column joined to the row, frequent words over several keys."""

    def label_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = {(rid, u) for rid, parts in zip(pdf["rid"], pdf["segments"]) for x in parts if len(x) > 1 for l in dict.fromkeys(x) for u in units(l)}
            yield pd.DataFrame(list(words), columns=["rid", "word"])

    def distinct_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"word": list({u for parts in pdf["segments"] for x in parts if len(x) > 1 for l in dict.fromkeys(x) for u in units(l)})}, dtype=object)

    needed = regions.select("segments").mapInPandas(distinct_words, "word string").distinct().join(vocabulary, "word")
    few = small_rows(needed, BOUND)
    if few is not None:
        sent = regions.sparkSession.sparkContext.broadcast({r["word"]: r["n"] for r in few})
        return regions, lambda _: sent.value
    salt = F.lit(16)
    spread = vocabulary.withColumn("salt", F.explode(F.sequence(F.lit(0), salt - 1)))
    words = regions.select("rid", "segments").mapInPandas(label_words, "rid long, word string").withColumn("salt", F.pmod(F.col("rid"), salt).cast("int"))
    counts = words.join(spread, ["word", "salt"]).groupBy("rid").agg(F.collect_list(F.struct("word", "n")).alias("counts"))
    return materialise(regions.join(counts, "rid", "left"), "p3-sites"), lambda rows: {r["word"]: r["n"] for r in (rows if rows is not None else [])}


def resolve(aligned: DataFrame, key: str = "aligned_key") -> tuple[DataFrame, Model]:
    """Consensus per region (key, entries, consensus_reading, agreement, wrong_engines) and the fitted model."""
    stored = materialise(_aligned(aligned.filter("engine_texts is not null"), key).withColumn("rid", F.monotonically_increasing_id()), "p3-aligned")
    vocabulary = stored.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    regions = stored.filter("segments is not null").select("rid", key, "entries", "engines", "segments")
    differ = F.exists("segments", lambda x: F.size(x) > 1)
    joined, count_of = _counted(regions.filter(differ), vocabulary)

    def sites(pdf: pd.DataFrame) -> Iterator[tuple[int, list[str], int, list[str], list[int], tuple[str, str]]]:
        """Index of the row, engines, index of the segment, labels, counts, texts before and after."""
        counts = pdf["counts"] if "counts" in pdf else [None] * len(pdf)
        for i, (engines, parts, rows) in enumerate(zip(pdf["engines"], pdf["segments"], counts)):
            if len(engines) < 2:
                continue
            count = count_of(rows)
            for k, x in enumerate(parts):
                if len(x) > 1:
                    around = (parts[k - 1][0] if k else "", parts[k + 1][0] if k + 1 < len(parts) else "")
                    of = {l: min((count.get(u, 0) for u in units(l)), default=0) for l in dict.fromkeys(x)}
                    yield i, list(engines), k, list(x), [of[l] for l in x], around

    def patterns_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            for _, engines, _, x, n, around in sites(pdf):
                total[pattern(engines, x, classes(x, n, around))] += 1
        yield pd.DataFrame(list(total.items()), columns=["pattern", "n"])

    same = stored.filter("segments is null and word is null").select(F.concat(F.array_join(F.transform("engines", lambda e: F.concat(e, F.lit("=0"))), ";"), F.lit("|0,8")).alias("pattern"), "n")
    patterns = materialise(joined.mapInPandas(patterns_of, "pattern string, n long").unionByName(same).groupBy("pattern").agg(F.sum("n").alias("n")), "p3-patterns")
    model = fit(patterns)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            chosen: list[dict[int, tuple[str, float]]] = [{} for _ in range(len(pdf))]
            wrong: list[set[str]] = [set() for _ in range(len(pdf))]
            for i, engines, k, x, n, around in sites(pdf):
                found = classes(x, n, around)
                order = list(found)
                p, _ = model.posterior(engines, [order.index(l) for l in x], list(found.values()))
                best = max(range(len(p)), key=lambda c: (p[c], model._weight(found[order[c]]), -c))
                chosen[i][k] = (order[best], p[best])
                wrong[i] |= {e for e, l in zip(engines, x) if l != order[best]}
            out = []
            for key_, n, parts, best, bad in zip(pdf[key], pdf["entries"], pdf["segments"], chosen, wrong):
                text = "".join(best[k][0] if k in best else x[0] for k, x in enumerate(parts)) if len(parts) else None
                sure = sum(len(tokens(x[0])) for k, x in enumerate(parts) if k not in best)
                agreement = (sure + sum(p for _, p in best.values())) / (sure + len(best)) if sure + len(best) else (1.0 if len(parts) else None)
                out.append((key_, n, text, agreement, sorted(bad)))
            yield pd.DataFrame(out, columns=[key, "entries", "consensus_reading", "agreement", "wrong_engines"])

    chosen = joined.mapInPandas(choose, f"{key} long, entries int, consensus_reading string, agreement double, wrong_engines array<string>")
    # where all agree there is nothing to choose
    one = F.get(F.get("segments", F.lit(0)), F.lit(0))
    plain = regions.filter(~differ).select(key, "entries", F.when(F.size("segments") > 0, one).alias("consensus_reading"), F.when(F.size("segments") > 0, F.lit(1.0)).alias("agreement"), F.array().cast("array<string>").alias("wrong_engines"))
    return chosen.unionByName(plain), model


def wrong_readings(aligned: DataFrame, key: str = "aligned_key", least: int = 3) -> DataFrame:
    """Readings that differ from the consensus, of regions with at least ``least`` entries."""
    found, _ = resolve(aligned, key)  # the smaller regions count in the model too
    return found.filter(F.col("entries") >= least).select(key, F.explode("wrong_engines").alias("engine"))


def reliability(model: Model, like: DataFrame) -> DataFrame:
    """Competence and guess distribution per engine."""
    rows = [(e, float(model.competence[e]), *map(float, model.guess[e])) for e in sorted(model.competence)]
    return like.sparkSession.createDataFrame(rows, "engine string, competence double, " + ", ".join(f"guess_{k} double" for k in KINDS))
