"""Problem 9: sentence boundaries across languages, scripts and page layouts, all in SQL expressions.

1. Layout. Every line becomes one segment, or two where columns stand side by side on one line. Segments are read
   column by column. Lines that stand for themselves (masthead, headline, advert title, page number) are told from running
   text by case, by being longer than the wrap width, by the space below, or by a break where the next word would have
   fitted. They are units of their own and leave the running text; what they interrupt goes on behind them.
2. Masking. In the running text, dots of initials and abbreviations, terminators inside quotations, those of web addresses
   at a line end and the quotation marks themselves are replaced by private-use placeholders, one character for one.
   Decimals and web addresses within a line need no mask: these terminators split only before white space.
3. Splitting. A marker is put behind every terminator of the script at hand that is left. As placeholders keep lengths,
   the markers give positions in the stored text, which is what "restoring" comes to: sentences are cut from it.

Everything up to the ends is a projection of one row: no shuffle, no Python; only sentences of several lines are put together
by a grouping inside their document. Defined results: null, empty and blank texts give no rows;
text without any terminator is one sentence; line boxes that are null or don't match the lines are ignored; repeated rows
give their sentences again; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Placeholders: quotation open and close, masked terminator, introduced quotation open and close, masked dot, the marker
# behind a sentence, a line that interrupts, a line that is no running text.
OPEN, CLOSE, INNER, SAID_OPEN, SAID_CLOSE, DOT, MARK, BREAK, ASIDE = map(chr, range(0xE001, 0xE00A))

# Abbreviations that don't end a sentence.
NEVER = (
    "Mr Mrs Ms Dr Dra Drs Prof Rev Hon Capt Col Gen Lt Sgt Maj St Ste Sr Sra Srta Mme Mlle MM Hr Hrn Frl No Nos Nr nr vol Vol ch "
    "Ch pp fig Fig art Art cf vgl bzgl sog núm pág págs cap Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec e.g i.e z.B d.h u.a viz "
    "S Bd Abs κ κα ул им стр см डॉ श्री د أ pl approx resp Kap Gebr Ave Blvd Rd"
).split()
# Abbreviations that end a sentence only where a new one begins behind them.
MAYBE = "p.m a.m Co Ltd Inc Bros doz etc usw usf Pfd Mk fr ptas pts m h s d p B E z е т д п г гг руб коп μ.Χ π.Χ ft in lb lbs oz cwt Jr Sen jun sen".split()
MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert"

CLOSERS = rf"[\"'”’»)\]』」{CLOSE}{SAID_CLOSE}]"


def _alternatives(xs: list[str]) -> str:
    return "|".join(x.replace(".", r"\.") for x in sorted(xs, key=lambda x: (-len(x), x)))


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def _has(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


_GAP = r"\S[ \u3000]{3,}\S"


def _segments(d: DataFrame) -> DataFrame:
    """Adds ``s``, the segments in the order of reading: text, start, y (null: unknown)."""
    d = d.withColumn("lines", F.split("t", "\n", -1))
    d = d.withColumn("ok", F.coalesce(F.size("boxes") == F.size("lines"), F.lit(False))).withColumn("left", F.array_min(F.transform("boxes", lambda b: b["x1"])))
    zero = F.array(F.lit(0).cast("long"))
    d = d.withColumn("starts", F.aggregate("lines", zero, lambda acc, l: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(l) + 1))))
    y = lambda i: F.when(F.col("ok"), F.get("boxes", i)["y1"])
    segment = lambda t, at, i: F.struct(t.alias("t"), at.alias("at"), y(i).alias("y"))
    plain = F.transform("lines", lambda l, i: segment(l, F.get("starts", i), i))
    right = lambda i: F.col("ok") & (F.get("boxes", i)["x1"] - F.col("left") > 300)
    # a masthead and its page number on one line are one unit
    two = lambda l: F.contains(l, F.lit("   ")) & _has(l, _GAP) & ~_has(l, r"[ \u3000]{3,}\d{1,4}\s*$")

    def part(l: Column, i: Column, column: int) -> Column:
        start = F.get("starts", i)
        if column == 0:
            return F.when(right(i), None).when(two(l), segment(F.regexp_extract(l, r"^(.*?\S)[ \u3000]{3,}\S", 1), start, i)).otherwise(segment(l, start, i))
        second = F.regexp_extract(l, r"^.*?\S[ \u3000]{3,}(\S.*)$", 1)
        return F.when(right(i), segment(l, start, i)).when(two(l), segment(second, start + F.length(l) - F.length(second), i))

    there = lambda s: s.isNotNull()
    both = F.concat(F.filter(F.transform("lines", lambda l, i: part(l, i, 0)), there), F.filter(F.transform("lines", lambda l, i: part(l, i, 1)), there))
    d = d.withColumn("mixed", (F.contains("t", F.lit("   ")) & _has(F.col("t"), _GAP)) | F.coalesce(F.col("ok") & (F.array_max(F.transform("boxes", lambda b: b["x1"])) - F.col("left") > 300), F.lit(False)))
    return d.withColumn("s", F.when(F.col("mixed"), both).otherwise(plain))


def _features(d: DataFrame) -> DataFrame:
    """Adds ``f``, per segment: text, start, length, what it looks like, distance to the next, length of the first word."""

    def one(s: Column, i: Column) -> Column:
        t = s["t"]
        trimmed = F.length(F.rtrim(t))
        start = F.substring(t, 1, 1)
        # line ends are told by their last characters, which is cheaper than a pattern over the line
        closing = F.lit(" \t\"'”’»)]』」“")
        tail = F.rtrim(F.substring(t, -6, 6), closing)  # trimming a whole line costs more than the rest
        last = F.substring(F.when(tail != "", tail).otherwise(F.rtrim(t, closing)), -1, 1)
        return F.struct(
            t.alias("t"),
            s["at"].alias("at"),
            trimmed.alias("n"),
            ((trimmed < 12) & ~_has(t, r"[\p{L}\p{N}]")).alias("none"),
            (last.isin(*".!?。！？؟।…;．") | (F.col("thai") & _has(t, "[\u0e00-\u0e7f] $"))).alias("ends"),
            (last == "-").alias("dash"),
            (start != F.upper(start)).alias("lower"),
            ((trimmed > 3) & ~_has(t, r"\p{Ll}") & _has(t, r"\p{Lu}[^\p{Lu}]*\p{Lu}[^\p{Lu}]*\p{Lu}[^\p{Lu}]*\p{Lu}")).alias("caps"),
            F.coalesce(F.get("s", i + 1)["y"] - s["y"], F.lit(0)).alias("gap"),
            F.when(F.col("spaced"), F.length(F.substring_index(t, " ", 1)) + 1).otherwise(F.length(F.regexp_extract(t, r"^[「『“（]*.[。、，．！？」』”）]*", 0))).alias("word"),
            ((s["at"] == 0) | (s["at"] + trimmed >= F.col("size"))).alias("edge"),
        )

    return d.withColumn("f", F.transform("s", one))


#: Vertical distance, in pixels of 300 DPI, from a line to the next that only a line standing for itself has.
TITLE_GAP = 58


def _bare(t: Column) -> Column:
    """Whether a line has none of the punctuation that running text has."""
    return ~_has(t, r"[.!?:;,“”„«»()。，、！？「」؟،।]|[฀-๿] [฀-๿]")


def _titles(d: DataFrame) -> DataFrame:
    """Adds ``w``, the wrap width (the longest line that surely runs on; null if none does), and ``signs``, per segment how surely it stands for itself: 3 by case, 2 by length or space, 1 by an early break, 0 not."""
    f = F.col("f")
    # lines that run on: before one in lower case; without case, such with punctuation and those behind them
    before = lambda i: F.get(f, i - 1)
    runs = lambda s, i: ~s["ends"] & (~_bare(s["t"]) | F.coalesce((i > 0) & ~before(i)["ends"] & ~_bare(before(i)["t"]), F.lit(False)))
    of = F.transform(f, lambda s, i: F.when(~s["none"] & ~s["caps"] & F.when(F.col("cased"), F.get(f, i + 1)["lower"]).otherwise(runs(s, i)), s["n"]))
    d = d.withColumn("sure", F.filter(of, lambda n: n.isNotNull()))
    # a few lines may all be shorter than the width
    d = d.withColumns({"w": F.array_max("sure"), "margin": F.when(F.col("spaced") & (F.size("sure") < 6), 3).otherwise(0)})

    def sign(s: Column, i: Column) -> Column:
        n = F.get(f, i + 1)
        able = ~s["ends"] & ~s["dash"] & ~s["lower"] & ~s["none"] & _bare(s["t"])
        far = F.coalesce(s["n"] > F.col("w") + F.col("margin"), F.lit(False)) | s["gap"].between(TITLE_GAP, TITLE_GAP + 40)
        early = ~n["lower"] & ~F.col("thai") & (s["n"] + n["word"] <= F.col("w"))
        return F.when(s["caps"], 3).when(F.coalesce(far, F.lit(False)) & able, 2).when(F.coalesce(early, F.lit(False)) & able, 1).otherwise(0)

    return d.withColumn("signs", F.transform(f, sign))


def _kinds(f: str, signs: str) -> Column:
    """Kind of every segment: 0 running text, 1 unit of its own, 2 a unit that interrupts running text, 3 nothing."""

    def kind(s: Column, i: Column) -> Column:
        own, after, before = F.get(signs, i), F.get(f, i + 1), F.get(f, i - 1)
        closed = F.when(i == 0, True).otherwise(before["ends"] | (F.get(signs, i - 1) > 0) | (before["edge"] & _has(before["t"], r"^\D{0,6}\d{1,4}\D{0,3}$")))
        number = s["edge"] & _has(s["t"], r"^\s*(?:Page |Seite |[-–—] ?)?\d{1,4}(?: ?[-–—])?\s*$")
        # an early break doesn't count where what follows breaks the run anyway
        rule = F.coalesce(after["none"], F.lit(False))
        broken = F.coalesce(F.get(signs, i + 1) > 0, F.lit(False))
        unit = number | (own == 3) | ((own == 2) & closed & ~rule) | ((own == 1) & ~rule & ((i == 0) | ~broken)) | ((i == 0) & ~s["ends"] & _bare(s["t"]) & after.isNull())
        return F.when(s["none"], 3).when(unit, F.when(closed & ~F.coalesce(before["none"], F.lit(False)), 1).otherwise(2)).otherwise(0)

    return F.transform(f, kind)


def _dots() -> str:
    """Dots that end no sentence: of initials and abbreviations, of an ellipsis that goes on, of a day before its month."""
    before = lambda what: rf"(?<=(?<![\p{{L}}\p{{N}}])(?:{what})\.)"
    return rf"\.(?=\s)(?<![a-z]{{5}}\.)(?:(?:{before(_alternatives(NEVER))}|{before(chr(92) + 'p{Lu}')})|(?=\s+[\p{{Ll}}\d(&—–-])(?:{before(_alternatives(MAYBE))}|(?<=\.\.\.))|(?=\s+(?:{MONTHS})\b)(?<=\d\.)|(?=\s+\p{{Lu}}\.)(?<=(?<!\p{{L}})[a-z]\.))"


def _marked(d: DataFrame) -> DataFrame:
    """Replaces ``m``, running text, by the same with a marker behind every sentence; every other character stays one character.

    Each step is a projection of its own, so no step's expression is evaluated more than once."""

    def step(pattern: str, to: str, only: Column | None = None) -> None:
        nonlocal d
        new = _sub(F.col("m"), pattern, to)
        d = d.withColumn("m", new if only is None else F.when(only, new).otherwise(F.col("m")))

    m, quotes = F.col("m"), F.col("quotes")
    for a, b in (("„", "“"), ("“", "”"), ("«", "»"), ("「", "」"), ("『", "』")):
        step(rf"{a}([^{a}{b}]*){b}", f"{OPEN}$1{CLOSE}", F.contains(m, F.lit(a)))
    d = d.withColumn("quotes", F.contains(m, F.lit(OPEN)))
    # terminators inside, from each opening mark on; a match begins where the last one ended
    step(rf"((?:{OPEN}|\G(?!\A))[^{CLOSE}.!?。！？؟।…]*)[.!?。！？؟।…]", f"$1{INNER}", quotes)
    step(rf"([:：]\s*){OPEN}([^{CLOSE}]*){CLOSE}", f"$1{SAID_OPEN}$2{SAID_CLOSE}", quotes)
    # a quotation after a colon ends the sentence; one that stands first does where a new sentence follows it
    step(rf"({INNER}\s*(?:{SAID_CLOSE}(?![.,;。])|{CLOSE}(?=\s+[\p{{Lu}}{OPEN}{SAID_OPEN}])))", f"$1{MARK}", quotes)
    # an abbreviation at the end of an interrupting advert ends its sentence, whatever goes on behind it
    step(rf"({BREAK}\n(?:[^\n{BREAK}{ASIDE}]*\n){{0,3}}?[^\n{BREAK}{ASIDE}]*(?:{_alternatives(MAYBE)})\.)(?=\n\p{{Ll}})", f"$1{MARK}", F.contains(m, F.lit(BREAK)))
    # a web address that goes on in the next line
    step(r"((?:https?://|www\.)\S*)[.?!](?=\n\p{Ll})", f"$1{DOT}", F.contains(m, F.lit("://")) | F.contains(m, F.lit("www.")))
    step(_dots(), DOT, F.contains(m, F.lit(".")))
    step(rf"([.!?]{CLOSERS}*+)(?=\s|$)", f"$1{MARK}")
    step(rf"([؟।…]+{CLOSERS}*+)(?=\s|$)", f"$1{MARK}", F.contains(m, F.lit("؟")) | F.contains(m, F.lit("।")) | F.contains(m, F.lit("…")))
    step(r"([。！？]+[』」”’]*|．(?=\s))" + f"(?!{MARK})", f"$1{MARK}", ~F.col("spaced"))
    step(r"(\p{IsGreek}»?;)(?=\s|$)", f"$1{MARK}", F.contains(m, F.lit(";")))
    step(r"([\u0e00-\u0e7f])( +)(?=[\u0e00-\u0e7f\n]|$)", f"$1{MARK}$2", F.col("thai"))
    # what is left at the end is a sentence too
    core = F.rtrim(m, F.lit(f" \n\t{BREAK}{ASIDE}"))
    d = d.withColumn("core", core)
    d = d.withColumn("m", F.when(F.endswith("core", F.lit(MARK)) | (F.col("core") == ""), m).otherwise(F.concat("core", F.lit(MARK), F.substr(m, F.length("core") + 1))))
    return d


def _flow(documents: DataFrame, key: str, text: str, boxes: str) -> DataFrame:
    """Per document the segments ``f``, their ``kinds``, and ``lines``: what running text has of each, with its marks."""
    box = F.col(boxes) if boxes in documents.columns else F.lit(None).cast("array<struct<x1:int,y1:int,x2:int,y2:int,conf:double>>")
    t = F.regexp_replace(F.col(text), f"[{OPEN}-{ASIDE}]", "?")
    d = documents.filter(F.col(text).rlike(r"[\p{L}\p{N}]")).select(F.col(key).alias("k"), t.alias("t"), box.alias("boxes"))
    d = d.withColumns({"size": F.length(F.regexp_replace("t", r"\s+$", "")), "spaced": ~_has(F.col("t"), r"[\u3040-\u30ff\u4e00-\u9fff]{6}"), "thai": _has(F.col("t"), r"[\u0e00-\u0e7f]{6}"), "cased": _has(F.col("t"), r"\n\p{Ll}")})
    d = _titles(_features(_segments(d))).select("k", "t", "f", "spaced", "thai", _kinds("f", "signs").alias("kinds"))
    flow = F.array_join(F.zip_with("f", "kinds", lambda s, k: F.when(k == 0, s["t"]).when(k == 2, F.lit(BREAK)).otherwise(F.lit(ASIDE))), "\n")
    return _marked(d.withColumn("m", flow)).select("k", "t", "f", "kinds", F.split("m", "\n", -1).alias("lines"))


def sentence_ends(documents: DataFrame, key: str = "doc_id", text: str = "text", boxes: str = "line_boxes") -> DataFrame:
    """(key, end_pos): position of the last non-blank character of every sentence and every unit that stands for itself."""
    d = _flow(documents, key, text, boxes)
    d = d.select("k", F.explode(F.arrays_zip("f", "kinds", "lines")).alias("z")).select("k", F.col("z.f.at").alias("at"), F.col("z.f.n").alias("n"), F.col("z.kinds").alias("kind"), F.col("z.lines").alias("line"))
    d = d.filter(F.col("kind").isin(1, 2) | F.col("line").contains(MARK))
    parts = F.split("line", MARK, -1)
    inside = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda j: F.length(F.array_join(F.slice(parts, 1, j), "")))
    ends = F.when(F.col("kind") == 0, inside).otherwise(F.array("n"))
    return d.select(F.col("k").alias(key), F.explode(ends).alias("e"), "at").select(key, (F.col("at") + F.col("e") - 1).cast("long").alias("end_pos"))


def sentence_units(documents: DataFrame, key: str = "doc_id", text: str = "text", boxes: str = "line_boxes") -> DataFrame:
    """(key, sentence_no, char_start, char_end, sentence): every sentence and every unit that stands for itself, in the order they end when read.

    The parts of a sentence on several lines stand one below the other, without what interrupts them; ``char_end`` is exclusive.
    Parts are numbered inside a document."""
    d = _flow(documents, key, text, boxes).withColumn("row", F.monotonically_increasing_id())
    z = d.select("row", "k", "t", F.posexplode(F.arrays_zip("f", "kinds", "lines")).alias("i", "z")).filter("z.kinds < 3")
    at, own = F.col("z.f.at"), F.col("z.kinds") > 0
    z = z.select("row", "k", "t", "i", at.alias("at"), own.alias("own"), F.col("z.f.n").alias("n"), F.when(own, F.array(F.lit(""))).otherwise(F.split(F.col("z.lines"), MARK, -1)).alias("parts"))
    size = lambda j: F.length(F.get("parts", j))
    begun = F.aggregate(F.sequence(F.lit(0), F.size("parts") - 1), F.array(F.lit(0)), lambda acc, j: F.concat(acc, F.array(F.element_at(acc, -1) + size(j))))
    z = z.withColumn("begun", begun).select("row", "k", "t", "i", "at", "own", "n", "begun", F.posexplode("parts").alias("j", "part"))
    start = F.col("at") + F.get("begun", F.col("j"))
    raw = F.substring(F.col("t"), (start + 1).cast("int"), F.when(F.col("own"), F.col("n")).otherwise(F.length("part")).cast("int"))
    closes = F.col("own") | (F.col("j") < F.size("begun") - 2)
    z = z.select("row", "k", "i", "j", "own", start.alias("start"), raw.alias("raw"), closes.alias("closes")).filter(F.col("closes") | (F.trim(F.regexp_replace("raw", r"\s", " ")) != ""))
    ahead = Window.partitionBy("row").orderBy("i", "j").rowsBetween(Window.unboundedPreceding, -1)
    z = z.withColumn("unit", F.when(F.col("own"), -1 - F.col("i")).otherwise(F.coalesce(F.sum((F.col("closes") & ~F.col("own")).cast("int")).over(ahead), F.lit(0))))
    lead = F.length("raw") - F.length(F.regexp_replace("raw", r"^\s+", ""))
    trimmed = F.regexp_replace(F.regexp_replace("raw", r"^\s+", ""), r"\s+$", "")
    parts = F.array_sort(F.collect_list(F.struct("i", "j", (F.col("start") + lead).alias("s"), (F.col("start") + lead + F.length(trimmed)).alias("e"), trimmed.alias("t"))))
    u = z.groupBy("row", "k", "unit").agg(parts.alias("p"))
    last = F.element_at("p", -1)
    no = F.row_number().over(Window.partitionBy("row").orderBy(last["i"], last["j"]))
    return u.select(F.col("k").alias(key), no.alias("sentence_no"), F.col("p")[0]["s"].cast("long").alias("char_start"), last["e"].cast("long").alias("char_end"), F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("sentence")).filter("sentence != ''")
