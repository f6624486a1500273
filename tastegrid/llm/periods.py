"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of words with a smallest period q (words q apart are identical) that no neighbouring word extends,
at least two periods long. The dictionary names all factors whose length is a power of two: a factor of length 2L
gets its name from the names of its two halves. Only factors that occur again in their text stay, so the
levels of ordinary texts are soon empty.

On each level the occurrences of a factor of length L that lie at most L/2 apart form an arithmetic progression, whose
difference is the factor's period. A run of period q, L <= q < 2L, that starts at s has the factor at s again at s + q.
Either s + q starts a progression; or the run that s lies in by the progression's difference ends within the period, and
then so does that of s + q at the same distance: the last members of both progressions lie q apart. So the distances
within 2L from the start of a progression to all earlier occurrences, and between the ends of progressions, propose
all periods; on the lowest level the differences themselves do so too. There the factor is short enough that every run
of the shortest counted length holds it twice. A proposal is extended both ways by comparing words, once per
stretch of proposals that touch; of proposals with the same extent the smallest period stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import BATCH_BYTES, arrow_type, column_values, text_of

MIN_LENGTH = 12
# Words of whole texts that a task names together.
WORDS_AT_ONCE = 1 << 20
# Pairs of occurrences that a task holds at a time.
PAIRS_AT_ONCE = 1 << 22


def lowest_level(min_length: int) -> int:
    """The largest power of two L with 3L - 1 <= ``min_length``: runs of a period below 2L then have room for L more words."""
    if min_length < 2:
        raise ValueError("a run has at least two words")
    level = 1
    while 6 * level - 1 <= min_length:
        level *= 2
    return level


def _pairs(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, k) for all k in [starts, ends) of each row, in portions of about ``PAIRS_AT_ONCE``."""
    sizes = np.maximum(ends - starts, 0)
    total = sizes.cumsum()
    row = 0
    while row < len(sizes):
        done = total[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(total, done + PAIRS_AT_ONCE, "right")))
        part = sizes[row:stop]
        rows = np.repeat(np.arange(row, stop), part)
        inside = np.arange(len(rows)) - np.repeat(part.cumsum() - part, part)
        yield rows, starts[rows] + inside
        row = stop


def _proposals(names: np.ndarray, at: np.ndarray, level: int, lowest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) from the occurrences ``at``, sorted by name and then place."""
    step = np.full(len(at), 1 << 60)
    same = names[1:] == names[:-1]
    step[1:][same] = np.diff(at)[same]
    begins = step > level // 2
    ends = np.append(begins[1:], True)
    least = 1 if lowest else level
    # Places in one increasing sequence, so that a distance within a name can be searched for.
    group = np.append(0, np.cumsum(~same))
    line = group * (int(at.max()) + 2 * level + 2) + at
    for chosen, others in ((np.flatnonzero(begins), np.arange(len(at))), (np.flatnonzero(ends), np.flatnonzero(ends))):
        known = line[others]
        low = np.searchsorted(known, line[chosen] - 2 * level)
        high = np.searchsorted(known, line[chosen] - least, "right")
        for rows, k in _pairs(low, high):
            place = at[others[k]]
            yield place, at[chosen[rows]] - place
    if lowest:
        inner = np.flatnonzero(~begins)
        inner = inner[begins[inner - 1]]
        yield at[inner - 1], step[inner]


def _extent(words: np.ndarray, begin: int, end: int, place: int, period: int) -> tuple[int, int]:
    """The stretch around ``place`` whose words equal those ``period`` later; from [begin, end), by growing windows."""
    last = end - period
    stop, width = place, 32
    while stop < last:
        upto = min(last, stop + width)
        differ = words[stop:upto] != words[stop + period : upto + period]
        if differ.any():
            stop += int(differ.argmax())
            break
        stop, width = upto, 2 * width
    start, width = place, 32
    while start > begin:
        since = max(begin, start - width)
        differ = words[since:start] != words[since + period : start + period]
        if differ.any():
            start -= int(differ[::-1].argmax())
            break
        start, width = since, 2 * width
    return start, stop + period


def find_runs(words: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, sorted, of texts laid end to end as word numbers."""
    ends = sizes.cumsum()
    text = np.repeat(np.arange(len(sizes)), sizes)
    level, lowest = 1, lowest_level(min_length)
    # Names are numbers of distinct (text, factor); -1 where the factor occurs once or would leave the text.
    name = _named(text, words)
    found: list[np.ndarray] = []
    while True:
        at = np.flatnonzero(name >= 0)
        if not len(at):
            break
        if level >= lowest:
            order = np.argsort(name[at], kind="stable")
            at = at[order]
            found += [np.stack(p) for p in _proposals(name[at], at, level, level == lowest)]
        if 2 * level > len(name):
            break
        both = np.flatnonzero((name[:-level] >= 0) & (name[level:] >= 0) & (text[:-level] == text[level:]))
        longer = np.full(len(name), -1)
        longer[both] = _named(name[both], name[both + level])
        name, level = longer, 2 * level
    place, period = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    runs = {}
    known, reach = (-1, -1), -1
    for p, q in zip(place.tolist(), period.tolist()):
        t = int(text[p])
        if known == (t, q) and p < reach:
            continue  # inside the last stretch of equal words
        begin, end = int(ends[t] - sizes[t]), int(ends[t])
        start, stop = _extent(words, begin, end, p, q)
        known, reach = (t, q), stop - q
        if stop - start >= max(min_length, 2 * q):
            runs.setdefault((t, start - begin, stop - start), q)  # periods come in rising order
    rows = sorted((t, s, n, q) for (t, s, n), q in runs.items())
    return np.array(sorted(rows, key=lambda r: (r[0], r[1], r[3])), np.int64).reshape(-1, 4)


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number per distinct pair; -1 for pairs that occur once."""
    if not len(left):
        return np.empty(0, np.int64)
    pair = left.astype(np.int64) * (int(right.max()) + 1) + right
    order = np.argsort(pair, kind="stable")
    first = np.append(True, pair[order][1:] != pair[order][:-1])
    number = first.cumsum() - 1
    often = np.bincount(number) > 1
    names = np.empty(len(pair), np.int64)
    names[order] = np.where(often[number], number, -1)
    return names


def periodic_runs(
    docs: DataFrame, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Runs of every whole text, and the text without the repeats in them.

    Returns the id column with ``n_words`` long, ``runs`` array of (start, length, period) in words by start and then
    period, and ``collapsed``: the words that no run contains after its first period, joined by one space. A word is a
    stretch without white space. A run has at least ``min_length`` words and two periods; runs never cross texts. One
    row per row of ``docs``, repeated rows included; a null or empty text has no words; a null id stays null; other
    columns are not read, whatever their names. A task holds some texts of about ``WORDS_AT_ONCE`` words together, or
    one longer text, and some numbers per word of them.
    """
    source = docs.select(F.col(id_col).alias("id"), F.encode(text_of(text_col), "UTF-8").alias("text"))
    key_type = arrow_type(source, "id")
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = (
        f"id {source.schema['id'].dataType.simpleString()}, n_words long, "
        "runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )

    def rows(keys: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts], np.int64)
        numbers: dict[bytes, int] = {}
        fresh = count()
        words = np.empty(int(sizes.sum()), np.int64)
        done = 0
        for t in texts:
            for w in set(t).difference(numbers):
                numbers[w] = next(fresh)
            words[done : done + len(t)] = np.fromiter(map(numbers.__getitem__, t), np.int64, len(t))
            done += len(t)
        found = find_runs(words, sizes, min_length)
        per_text = np.bincount(found[:, 0], minlength=len(texts)) if len(found) else np.zeros(len(texts), np.int64)
        places = np.append(0, per_text.cumsum())
        collapsed = []
        for i, t in enumerate(texts):
            mine = found[places[i] : places[i + 1]]
            if len(mine):
                gone = np.zeros(len(t) + 1, np.int64)
                np.add.at(gone, mine[:, 1] + mine[:, 3], 1)
                np.add.at(gone, mine[:, 1] + mine[:, 2], -1)
                t = [t[k] for k in np.flatnonzero(gone[:-1].cumsum() == 0)]
            collapsed.append(b" ".join(t))
        runs = pa.StructArray.from_arrays([pa.array(found[:, k].copy()) for k in (1, 2, 3)], fields=list(run_type))
        columns = [
            pa.array(keys, key_type),
            pa.array(sizes),
            pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), runs),
            pa.array(collapsed, pa.binary()).cast(pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, words, held = [], [], 0, 0
        for batch in batches:
            for key, text in zip(column_values(batch, "id"), column_values(batch, "text")):
                keys.append(key)
                texts.append(text.split())  # bytes are split at \x20 and \x09-\x0D
                words += len(texts[-1])
                held += len(text)
                if words >= WORDS_AT_ONCE or held >= BATCH_BYTES:
                    yield rows(keys, texts)
                    keys, texts, words, held = [], [], 0, 0
        if keys:
            yield rows(keys, texts)

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Numbers of the longest run (ties: smallest start, then period), and digests of runs and collapsed text."""
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", F.array_max(ranked)).withColumn("period", -F.col("best.p"))
    return best.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        "period",
        F.expr("1000 * best.length div period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
