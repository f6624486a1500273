"""Quality rules with adaptive limits, in DataFrame operations only.

Measures of every whole text are summarised by mergeable quantile sketches (KLL) per language and source. The
limits follow from the upper quantiles of a document's own group: no measure may lie far above them. A group too
small to say takes the limits of its language, or of all documents; a little larger ones are between. Filtering
is a join of the measured documents with the limits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import BLANK, only_kept, text_of
from tastegrid.sources.session import materialize

# Fixed by the contract: shortest text in words, and the share of repeated words that fails a text.
FEWEST_WORDS = 50
MOST_REPEATED_PERCENT = 50
# Items a sketch keeps per level (rank error about 0.3 %); rows up to which a group's own sketch isn't used, and
# from which it alone is.
SKETCH_K = 1024
FEWEST_ROWS = 100
ENOUGH_ROWS = 150
# Added to the number of lines: one repeated line of three says little about a text.
FEW_LINES = 3
# A limit is the group's upper quantile and so many times its distance from the median.
UPPER = 0.85
SPREADS = 3.0
# Only keeps rounding from deciding where a group has no spread.
EPSILON = 0.005
# Standard errors by which a count may exceed its limit by chance: few symbols or repeated lines prove nothing.
ERRORS = 2.0
# A measure's count and what it is divided by; a mean has no count.
MEASURES = {
    "symbol_rate": ("n_symbols", "word_chars", 0),
    "dup_line_rate": ("n_dup_lines", "n_lines", FEW_LINES),
    "repeat_rate": ("n_repeat_words", "n_words", FEWEST_WORDS),
    "upper_rate": ("n_upper", "word_chars", 0),
    "word_length": ("word_chars", "n_words", 0),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once: as a lambda's argument it isn't copied into each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(text, rf"[\x09-\x0D][{BLANK}]*|\x20[{BLANK}]+", " "))
    return F.when(flat == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(flat, " "))


def repeated_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more among the ``words``, first ones included.

    Windows are sorted by 33 bits of a hash with their place in the other bits, all in one array of long integers.
    Neighbours with equal bits are compared as strings, so the count is exact.
    """

    def window(i: Column) -> Column:
        return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def beside(items: Column, key: Callable[[Column], Column]) -> Column:
        """The items whose key equals that of a neighbour."""
        return F.filter(
            items,
            lambda x, j: key(x).eqNullSafe(key(F.get(items, j - 1))) | key(x).eqNullSafe(key(F.get(items, j + 1))),
        )

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def exact(candidates: Column) -> Column:
        place = F.transform(candidates, lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
        texts = F.array_sort(F.transform(place, lambda i: F.struct(window(i).alias("s"), i.alias("i"))))
        same = let(texts, lambda t: beside(t, lambda x: x["s"]))
        return let(F.array_sort(F.transform(same, lambda x: x["i"])), covered)

    hashed = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.shiftleft(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), 31).bitwiseOR(
            i.cast("long")
        ),
    )
    candidates = let(F.sort_array(hashed), lambda s: beside(s, lambda x: F.shiftrightunsigned(x, 31)))
    counted = let(candidates, lambda c: F.when(F.size(c) == 0, F.lit(0).cast("long")).otherwise(exact(c)))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(counted)


def measured(docs: DataFrame, id_col: str, text_col: str, group_cols: tuple[str, str]) -> DataFrame:
    """(id, h, g0, g1, counts, base_failed, rates) of every row; no text is carried on."""
    text = text_of(text_col)
    row = docs.select(
        F.col(id_col).alias("id"),
        *[F.col(c).cast("string").alias(f"g{i}") for i, c in enumerate(group_cols)],
        F.xxhash64(text).alias("h"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{BLANK}]")).alias("lines"),
        words_of(text).alias("words"),
    )
    counted = row.select(
        "id",
        "h",
        "g0",
        "g1",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_upper",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        let(F.col("words"), repeated_words).alias("n_repeat_words"),
    )
    few = F.col("n_words") < FEWEST_WORDS
    repeated = F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED_PERCENT) * F.col("n_words")

    return counted.select("*", (few | repeated).alias("base_failed"), *[_rate(m).alias(m) for m in MEASURES])


def _rate(m: str, errors: float = 0.0) -> Column:
    """The measure, or its lower bound by that many standard errors of its count."""
    count, size, few = MEASURES[m]
    low = F.col(count) - F.lit(errors) * F.sqrt(count) if errors and m != "word_length" else F.col(count)
    return F.when(F.col(size) > 0, low / (F.col(size) + few)).otherwise(F.lit(0.0))


def limits(rows: DataFrame) -> DataFrame:
    """(g0, g1, a limit per measure) for every group of the measured ``rows``."""
    sketch = [F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in MEASURES]
    merge = [F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in MEASURES]
    own = materialize(rows.groupBy("g0", "g1").agg(F.count(F.lit(1)).alias("n"), *sketch), "sketches").alias("own")
    language = own.groupBy("g0").agg(F.sum("n").alias("n"), *merge).alias("language")
    everything = own.agg(F.sum("n").alias("n"), *merge).alias("everything")
    levels = own.join(language, F.col("own.g0").eqNullSafe(F.col("language.g0")), "left").crossJoin(F.broadcast(everything))

    def share(level: str) -> Column:
        part = (F.col(f"{level}.n") - FEWEST_ROWS) / F.lit(float(ENOUGH_ROWS - FEWEST_ROWS))
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), part))

    def limit(m: str) -> Column:
        def of(level: str) -> Column:
            middle, upper = (F.kll_sketch_get_quantile_double(F.col(f"{level}.{m}"), F.lit(q)) for q in (0.5, UPPER))
            return upper + SPREADS * (upper - middle) + EPSILON

        wider = share("language") * of("language") + (1 - share("language")) * of("everything")
        return (share("own") * of("own") + (1 - share("own")) * wider).alias(f"{m}_limit")

    return levels.select("own.g0", "own.g1", *[limit(m) for m in MEASURES])


def judged(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source")
) -> DataFrame:
    rows = materialize(measured(docs, id_col, text_col, group_cols), "measures").alias("r")
    bounds = materialize(limits(rows), "limits").alias("b")
    same = F.col("r.g0").eqNullSafe(F.col("b.g0")) & F.col("r.g1").eqNullSafe(F.col("b.g1"))
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & (_rate(m, ERRORS) <= F.col(f"b.{m}_limit"))
    kept = ~F.col("r.base_failed") & F.coalesce(inside, F.lit(True))
    return rows.join(bounds, same, "left").select("r.*", *[f"b.{m}_limit" for m in MEASURES], kept.alias("kept"))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source")
) -> DataFrame:
    """The counts of every row, ``base_failed``, each measure with its limit, and ``kept``.

    ``kept`` is false where ``base_failed`` (fewer than 50 words, or over half of them in repeated windows) or
    where a measure lies above its limit by more than two standard errors of its count. The limit is the 85 % quantile
    of the group and three times its distance from the median. Groups of up to 100 rows take the limit of their
    language, or of all; up to 150 rows the two are mixed. Null and empty texts have no words and fail. Null languages
    and sources are groups of their own. Repeated rows each get a row and count each. Sketches are exact up to about
    a thousand rows of a group; beyond, a limit may move by a rank of 0.3 % between runs. Other columns
    are not read.
    """
    return judged(docs, id_col, text_col, group_cols).withColumnRenamed("id", id_col).drop("h", "g0", "g1")


def keep_good(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source")
) -> DataFrame:
    """The documents, all columns, that the rules keep; rows that repeat id and text leave one row.

    A document that stands in several groups stays if it is kept in any.
    """
    kept = judged(docs, id_col, text_col, group_cols).where("kept").select("id", "h").distinct()
    return only_kept(docs, materialize(kept, "kept"), id_col, text_col)
