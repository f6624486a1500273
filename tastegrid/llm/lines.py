"""Removal of repeated line runs by a suffix array over line ids.

A document is the sequence of its lines' ids; a line's id is checked against its content. Distributed prefix doubling
ranks all places by the run that starts there: by one line, then by two, four and so on, each time from the ranks of two touching
halves, until no run occurs twice. Ranks follow the sorted order of the runs, as in a suffix array, and places of equal rank
form an interval whose common prefix has at least that many lines. A place whose run occurs only once leaves the table as
soon as that shows. Going back from the longest runs to single lines, the places of an interval are divided by the run that
follows, as far as one is shared: that leaves each place with its longest common prefix with any other place, a maximal run.

Of the places of an interval the first stays, and the lines of its later places go, if the common prefix counts by its size:
so many lines, or so many words in fewer. Longer runs are the unions of overlapping places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import BLANK, text_of
from tastegrid.sources.session import materialize, scratch_tables

MIN_LINES, MIN_WORDS = 3, 50
PLACE = ["id", "h", "at"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hashes(line: Column) -> list[Column]:
    """A line's id: two 64-bit hashes."""
    return [F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b")]


def _worded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, at, words, line, a, b): lines with a word, numbered without the others."""
    text = text_of(text_col)
    lines = F.filter(_lines(text), lambda x: x.rlike(rf"[^{BLANK}]"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.posexplode(lines).alias("at", "line"))
    words = F.regexp_count("line", F.lit(rf"[^{BLANK}]+")).cast("bigint").alias("words")
    return rows.select(*PLACE, words, "line", *_hashes(F.col("line")))


def _places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, at, words, a): the places of repeated lines with the line's rank.

    Counting combines before the shuffle, and brings the least and the greatest content of an id: where they differ, the
    id stands for several lines, and their contents take part in it.
    """
    worded = _worded(docs, id_col, text_col)
    sides = [F.count(F.lit(1)).alias("n"), F.min("line").alias("low"), F.max("line").alias("high")]
    counts = materialize(worded.groupBy("a", "b").agg(*sides).where("n > 1"), "line-counts")
    shared = counts.where("low <> high").select("a", "b")
    if shared.isEmpty():
        places = worded.drop("line").withColumn("c", F.lit(""))
        counts = counts.select("a", "b", F.lit("").alias("c"))
    else:
        several = shared.withColumn("several", F.lit(True))
        content = F.when(F.col("several"), F.col("line")).otherwise("").alias("c")
        named = worded.join(several, ["a", "b"], "left").select(*PLACE, "words", "a", "b", content)
        places = materialize(named, "named-lines")
        counts = places.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return _with_ranks(places, counts, ["a", "b", "c"], distinct=True)


def _with_ranks(places: DataFrame, repeated: DataFrame, keys: list[str], distinct: bool = False) -> DataFrame:
    """The places with a key in ``repeated``, with the key's rank in ``a``.

    Distinct repeated keys are sorted by range; their row numbers, partition first, are the ranks. Both sides of the
    join are written tables, where a hot run's rows are split.
    """
    ordered = repeated.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranks = materialize(ordered.withColumn("rank", F.monotonically_increasing_id()), "ranks")
    kept = [c for c in places.columns if c not in keys]
    found = places.join(ranks, keys).select(*kept, F.col("rank").alias("a"))
    return materialize(found.distinct() if distinct else found, "places")


def _ranked(places: DataFrame, keys: list[str]) -> DataFrame:
    """The places whose ``keys`` others share, with the rank of the keys in ``a``; a hot run costs a row per task."""
    counts = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    return _with_ranks(places, counts, keys)


def _same_place(left: str, right: str, shift: Column | int = 0) -> Column:
    """Equality of places; the right one lies ``shift`` lines further."""
    (i, h, at), (j, g, to) = ([F.col(f"{side}.{c}") for c in PLACE] for side in (left, right))
    return i.eqNullSafe(j) & (h == g) & (at + shift == to)


def _joined(left: DataFrame, right: DataFrame, shift: int) -> DataFrame:
    """(id, h, at, words, a, b): runs of ``left``, and those of ``right`` that start ``shift`` lines further."""
    both = left.alias("l").join(right.alias("r"), _same_place("l", "r", shift))
    words = (F.col("l.words") + F.col("r.words")).alias("words")
    return both.select(*[f"l.{c}" for c in PLACE], words, "l.a", F.col("r.a").alias("b"))


def doubled_ranks(docs: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """Tables (id, h, at, words, a) of the places whose next 1, 2, 4, ... lines occur at another place too."""
    levels = [_places(docs, id_col, text_col)]
    while True:
        pairs = materialize(_joined(levels[-1], levels[-1], 1 << (len(levels) - 1)), "pairs")
        longer = _ranked(pairs, ["a", "b"])
        if longer.isEmpty():
            return levels
        levels.append(longer)


def _runs_of(levels: list[DataFrame], length: int) -> DataFrame | None:
    """The table of repeated runs of any length, from the largest power of two and the rest; None if there are none."""
    half = length.bit_length() - 1
    if half >= len(levels):
        return None
    if length == 1 << half:
        return levels[half]
    rest = _runs_of(levels, length - (1 << half))
    return _ranked(materialize(_joined(levels[half], rest, 1 << half), "pairs"), ["a", "b"])


def longest_prefixes(levels: list[DataFrame]) -> DataFrame:
    """(id, h, at, length, run): the longest common prefix of each place with any other, and its interval.

    From the longest doubled runs down, the places of an interval that are followed by a run of that length which another place
    of the interval has too move on to a narrower interval. One of them stays behind as a guide: places that share less
    with it still find it. Guides without a place to wait for are dropped.
    """
    state = levels[0].select(*PLACE, F.lit(0).alias("length"), F.lit(0).cast("bigint").alias("run"), F.lit(False).alias("guide"))
    for k in range(len(levels) - 1, -1, -1):
        near = state.alias("l").join(levels[k].alias("r"), _same_place("l", "r", F.col("l.length")), "left")
        near = materialize(near.select("l.*", F.col("r.a").alias("a")), "followed")
        shared = near.where(F.col("a").isNotNull()).groupBy("run", "a")
        sides = [F.count(F.lit(1)).alias("n"), F.count_if(~F.col("guide")).alias("seeking"), F.max("length").alias("length")]
        shared = shared.agg(*sides, F.min(F.struct(*PLACE)).alias("one")).where("n > 1 AND seeking > 0")
        numbers = materialize(shared.withColumn("next", F.monotonically_increasing_id() + ((k + 1) << 56)), "intervals")
        known = near.join(numbers.select("run", "a", "next"), ["run", "a"], "left")
        known = materialize(known, "moved")
        ahead = known.where(F.col("next").isNotNull())
        ahead = ahead.select(*PLACE, (F.col("length") + (1 << k)).alias("length"), F.col("next").alias("run"), "guide")
        behind = known.where(F.col("next").isNull()).select(*PLACE, "length", "run", "guide")
        stay = numbers.select(*[F.col(f"one.{c}") for c in PLACE], "length", "run", F.lit(True).alias("guide"))
        seeking = behind.where(~F.col("guide"))
        # Guides of the outermost interval stay; those of others meet a written table, so that a hot interval is split.
        waiting = materialize(seeking.where("run <> 0").select("run").distinct(), "waiting")
        guides = behind.where("guide").unionByName(stay)
        inner = guides.where("run <> 0").join(waiting, "run", "left_semi").select(*ahead.columns)
        state = ahead.unionByName(seeking).unionByName(guides.where("run = 0")).unionByName(inner)
        state = materialize(state, "prefixes")
    return state.where(~F.col("guide")).drop("guide")


def _later_copies(runs: DataFrame, length: int) -> DataFrame:
    """(id, h, at, length): the places of an interval behind its first that do not overlap it."""
    first = F.min(F.struct(F.col("id").isNull().alias("last"), *PLACE)).alias("first")
    firsts = materialize(runs.groupBy("a").agg(first), "firsts")
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))
    copies = runs.join(firsts, "a").where(~own | (F.col("at") >= F.col("first.at") + length))
    return copies.select(*PLACE, F.lit(length).alias("length"))


def _removed(docs: DataFrame, min_lines: int, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, h, ats, longest): sorted numbers of the lines to remove, counted among those with a word, and the longest repeated run."""
    if min_lines < 1 or min_words < 1:
        raise ValueError("a run has at least one line and one word")
    with scratch_tables(docs.sparkSession):
        levels = doubled_ranks(docs, id_col, text_col)
        copies = levels[0].where("false").select(*PLACE, F.lit(0).alias("length"))
        for length in range(1, min_lines + 1):
            runs = _runs_of(levels, length)
            if runs is not None:
                counted = runs if length == min_lines else runs.where(F.col("words") >= min_words)
                copies = copies.unionByName(_later_copies(counted, length))
        covered = copies.select("id", "h", F.explode(F.sequence("at", F.col("at") + F.col("length") - 1)).alias("at"))
        gone = covered.withColumn("longest", F.lit(None).cast("int"))
        both = gone.unionByName(
            longest_prefixes(levels).groupBy("id", "h").agg(F.max("length").alias("longest")).withColumn("at", F.lit(None).cast("int"))
        )
        found = both.groupBy("id", "h").agg(F.array_sort(F.collect_set("at")).alias("ats"), F.max("longest").alias("longest"))
        return materialize(found, "removed", keep=True)


def remove_repeated_lines(
    docs: DataFrame,
    min_lines: int = MIN_LINES,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """(id, text, n_lines, n_removed, n_runs, longest_run) of every row: the text without later copies of line runs.

    A run counts if it has ``min_lines`` lines, or ``min_words`` words in fewer. A line goes if it is in a counted run that
    occurs at an earlier place too: in a document of a smaller id (null ids come last, equal ids in the order of a hash of
    their texts), or earlier in the same document without overlap. Lines without a word are no part of runs and
    stay. ``n_lines`` counts the lines with a word, ``n_runs`` the maximal removed stretches; ``longest_run`` is the
    length of the longest run that occurs at another place as well, 0 without one. Null texts count as empty. Rows that
    repeat id and text are one document, so they aren't copies of each other, and each gets the same result. Other
    columns are not read.
    """
    removed = _removed(docs, min_lines, min_words, id_col, text_col).alias("r")
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text")).alias("d")
    same = F.col("d.id").eqNullSafe(F.col("r.id")) & (F.col("d.h") == F.col("r.h"))
    # Merged at every size: texts move once, whether the removed lines would fit a broadcast or not.
    joined = rows.join(removed.hint("merge"), same, "left").select("d.*", "r.ats", "r.longest")
    split = joined.withColumn("lines", _lines(F.col("text")))
    numbers = F.sequence(F.lit(0), F.size("lines") - 1)
    worded = F.filter(numbers, lambda i: F.get("lines", i).rlike(rf"[^{BLANK}]"))
    split = split.withColumn("worded", worded)
    gone = F.transform("ats", lambda at: F.get("worded", at))
    kept = F.transform(F.array_except(numbers, gone), lambda i: F.get("lines", i))
    starts = F.filter("ats", lambda x, j: (j == 0) | (F.get("ats", j - 1) != x - 1))
    some = F.size("ats") > 0  # false or null for documents that lose no line
    return split.select(
        F.col("id").alias(id_col),
        F.when(some, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text"),
        F.size("worded").cast("long").alias("n_lines"),
        F.when(some, F.size("ats")).otherwise(0).cast("long").alias("n_removed"),
        F.when(some, F.size(starts)).otherwise(0).cast("long").alias("n_runs"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest_run"),
    )
