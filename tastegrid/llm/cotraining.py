"""A quality classifier by co-training of two views.

One view sees a text's words and their shapes, the other the page's metadata: language, source, length, and where a
page of the document is known, its address, title and links. Each view is a naive Bayes classifier over hashed
features. In each round either view labels the unlabelled documents that it is surest of, for the other view to
learn from. In the end both views are calibrated on labelled documents that neither learned from, and their
calibrated log-odds are added to score every document.

Of the labelled documents a bounded sample is learned from (``MAX_LABELLED``); all unlabelled ones may get a
pseudo-label. Features are counted once and written. A step of a round reads them twice: tasks count how sure the
view is of each document, from which the driver finds the level that the surest share lies above, and then add up the
features of the documents above it. What earlier steps gave is found again from their weights and levels, so no
table of pseudo-labels is kept.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import arrow_type, column_values, text_of
from tastegrid.sources.session import materialize, scratch_tables

# Labelled documents that are learned from, drawn by a hash of the id from all there are.
MAX_LABELLED = 8_000
BUCKETS = 1 << 15
ROUNDS = 4
# Pseudo-labels that a view gives in a round, as a share of the unlabelled documents, and the least certainty.
GIVEN = 0.15
CERTAIN = 0.9
# Share of the labelled documents that only calibrates.
HELD_OUT = 0.25
SMOOTHING = 1.0
# Levels of certainty between the least and the highest log-odds. Within a level a hash of the id decides.
LEVELS = 1 << 14
LEAST_ODDS = float(np.log(CERTAIN / (1 - CERTAIN)))
MOST_ODDS = 30.0
# Shares are added up as multiples of this part, so that sums don't depend on their order.
PARTS = 1 << 32
# Features of documents that are held at a time, and documents or pages whose features are counted at a time.
ENTRIES = 1 << 20
ROWS_AT_ONCE = 256
TOKENS_KEPT = 200_000
TEXT, META = 0, 1


def shape(word: str) -> str:
    """A whole word with letters and digits as classes, runs of a class as one: ``Thing!!`` is ``Aa!!``."""
    plain = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return re.sub(r"([Aa0])\1+", r"\1", plain)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``ROWS_AT_ONCE`` rows, so that few counts are held as Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(i, ROWS_AT_ONCE)


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


class TextFeatures:
    """Counts of hashed words, word shapes and immediate repetitions in a text."""

    def __init__(self) -> None:
        self.kept: dict[str, tuple[int, int]] = {}
        self.repeat = bucket("repeat")

    def of(self, word: str) -> tuple[int, int]:
        known = self.kept.get(word)
        if known is None:
            known = bucket("word " + word.lower()), bucket("shape " + shape(word))
            if len(self.kept) >= TOKENS_KEPT:
                self.kept.clear()
            if len(word) <= 48:
                self.kept[word] = known
        return known

    def __call__(self, text: str) -> dict[int, int]:
        words = text.split()
        out: dict[int, int] = {}
        for word, n in Counter(words).items():
            a, b = self.of(word)
            out[a] = out.get(a, 0) + n
            out[b] = out.get(b, 0) + n
        repeats = sum(map(str.__eq__, words, words[1:]))
        if repeats:
            # as strong as all the words that repeat
            out[self.repeat] = out.get(self.repeat, 0) + 2 * repeats
        return out


def page_features(url, title, links) -> Counter:
    """Features of one page: its address, the shapes in its title and the number of its links."""
    host = re.sub(r"^.*?://|[/?#].*$", "", url or "").lower()
    names = [f"host {host}", f"top {host.rpartition('.')[2]}", f"scheme {(url or '').partition(':')[0]}"]
    names += [f"query {q}" for q in re.findall(r"[?&]([a-z_]+)=", url or "")]
    names += [f"links {int(links or 0).bit_length()}"]
    names += [f"title {s}" for s in {shape(w) for w in (title or "").split()}]
    return Counter(map(bucket, names))


def meta_features(lang, source, size, pages: dict[int, int] | None = None) -> dict[int, int]:
    """Features of a document's metadata and of all its pages together; whatever is null is a feature of its own."""
    names = [f"lang {lang}", f"source {source}", f"size {int(size or 0).bit_length()}"]
    return dict(Counter(map(bucket, names)) + Counter(pages or {}))


def pack(rows: list[dict[int, int]]) -> tuple[pa.Array, pa.Array]:
    """Buckets and counts of each row as binary columns."""
    index = [np.fromiter(r, "<u2", len(r)).tobytes() for r in rows]
    count = [np.fromiter(r.values(), "<u4", len(r)).tobytes() for r in rows]
    return pa.array(index, pa.binary()), pa.array(count, pa.binary())


class Examples:
    """Feature counts of documents as sparse rows."""

    def __init__(self, rows: list[dict[int, int]]):
        self._set(
            np.array([len(r) for r in rows], np.int64),
            np.array([k for r in rows for k in r], np.int64),
            np.array([v for r in rows for v in r.values()], np.float64),
        )

    @classmethod
    def packed(cls, index: list[bytes], count: list[bytes]) -> Examples:
        out = cls.__new__(cls)
        sizes = np.array([len(x) // 2 for x in index], np.int64)
        out._set(sizes, np.frombuffer(b"".join(index), "<u2").astype(np.int64), np.frombuffer(b"".join(count), "<u4").astype(np.float64))
        return out

    def _set(self, sizes: np.ndarray, index: np.ndarray, count: np.ndarray) -> None:
        self.sizes, self.index, self.count, self.n = sizes, index, count, len(sizes)
        self.owner = np.repeat(np.arange(self.n), sizes)
        self.total = np.maximum(np.bincount(self.owner, count, self.n), 1)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """The mean weight of each document's features."""
        return np.bincount(self.owner, self.count * weights[self.index], self.n) / self.total

    def sums(self, labels: np.ndarray, use: np.ndarray, each: np.ndarray | float = 1.0) -> np.ndarray:
        """The features' shares of the documents in ``use`` by class, in ``PARTS``; a document adds ``each``."""
        out = np.zeros((2, BUCKETS), np.int64)
        per = each / self.total
        for y in (0, 1):
            mine = (use & (labels == y))[self.owner]
            share = np.rint(self.count[mine] * per[self.owner[mine]] * PARTS)
            out[y] = np.bincount(self.index[mine], share, BUCKETS).astype(np.int64)
        return out

    def fit(self, labels: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Naive Bayes log-odds of each feature from the documents in ``use``, each counting as one."""
        return log_odds(self.sums(labels, use))


def log_odds(sums: np.ndarray) -> np.ndarray:
    smooth = sums / PARTS + SMOOTHING / 100
    bad, good = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    return good - bad


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log-odds of ``y`` over ``x``: logistic regression by Newton steps."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return 0.0, float(np.log(p / (1 - p)))
    mean, spread = x.mean(), x.std() or 1.0
    z = np.stack([(x - mean) / spread, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - np.array([0.1, 0.0]) * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag([0.1, 1e-6])
        w = w + np.linalg.solve(hess, grad)
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


class Step(NamedTuple):
    """A view's model in a round, and for either class the level it gives labels from, with the share of that level."""

    view: int
    weights: np.ndarray
    slope: float
    shift: float
    cuts: tuple[tuple[int, float], ...] = ()


class Block(NamedTuple):
    """Documents in both views; ``order`` is a hash of the id in [0, 1), ``each`` what a document counts."""

    views: list[Examples]
    order: np.ndarray
    each: np.ndarray

    def given(self, steps: Sequence[Step]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the last step: the levels by class (-1: unsure, or labelled before), what they are levels of, the labels given."""
        taken = [np.zeros(len(self.order), bool) for _ in self.views]
        for step in steps:
            odds = step.slope * self.views[step.view].scores(step.weights) + step.shift
            sure = np.minimum(np.abs(odds), MOST_ODDS)
            level = ((sure - LEAST_ODDS) / (MOST_ODDS - LEAST_ODDS) * (LEVELS - 1)).astype(np.int64)
            level = np.where((sure >= LEAST_ODDS) & ~taken[1 - step.view], level, -1)
            side = (odds > 0).astype(np.int64)
            labels = np.full(len(odds), -1)
            for y, (last, part) in enumerate(step.cuts):
                labels[(side == y) & (level >= 0) & ((level > last) | (level == last) & (self.order < part))] = y
            taken[1 - step.view] |= labels >= 0
        return level, side, labels

    def levels(self, steps: Sequence[Step]) -> np.ndarray:
        level, side, _ = self.given(steps)
        sure = level >= 0
        return np.bincount(side[sure] * LEVELS + level[sure], np.rint(self.each[sure] * PARTS), 2 * LEVELS).astype(np.int64)

    def sums(self, steps: Sequence[Step]) -> np.ndarray:
        _, _, labels = self.given(steps)
        return self.views[1 - steps[-1].view].sums(labels, labels >= 0, self.each).ravel()


class InMemory:
    """Labelled and unlabelled documents of one process."""

    def __init__(self, views: list[Examples], labels: np.ndarray, held_out: np.ndarray):
        n = len(labels)
        self.views, self.all_labels, self.held = views, labels, held_out[labels >= 0]
        self.labels, self.size = labels[labels >= 0], int((labels < 0).sum())
        self.block = Block(views, np.arange(n) * 0.6180339887 % 1, (labels < 0).astype(float))
        self.learn = (labels >= 0) & ~held_out

    def scores(self, view: int, weights: np.ndarray) -> np.ndarray:
        return self.views[view].scores(weights)[self.all_labels >= 0]

    def learned(self) -> np.ndarray:
        return np.stack([v.sums(self.all_labels, self.learn) for v in self.views])

    def levels(self, steps: Sequence[Step]) -> np.ndarray:
        return self.block.levels(steps)

    def sums(self, steps: Sequence[Step]) -> np.ndarray:
        return self.block.sums(steps)


def cuts_of(levels: np.ndarray, wanted: Sequence[int]) -> tuple[tuple[int, float], ...]:
    """For either class the level in which the wanted count of the surest ends, and the share of it that belongs to them."""
    out = []
    for counts, n in zip(levels.reshape(2, LEVELS) / PARTS, wanted):
        above = np.cumsum(counts[::-1])[::-1]  # documents of a level or higher
        last = int(np.flatnonzero(above >= n).max(initial=0))
        more = above[last] - counts[last]
        out.append((last, float((n - more) / counts[last]) if counts[last] > n - more else 1.0))
    return tuple(out)


def cotrain(views: list[Examples], labels: np.ndarray, held_out: np.ndarray, rounds: int = ROUNDS):
    """Weights and calibration of each view. ``labels`` is 0, 1, or -1 for unlabelled documents."""
    return cotrain_on(InMemory(views, labels, held_out), rounds)


def cotrain_on(source: InMemory | OnSpark, rounds: int = ROUNDS):
    """``cotrain`` over documents that only ``source`` sees: labelled scores, levels and sums come back."""
    y, held = source.labels, source.held
    learn, check = ~held, held
    if len(set(y[check])) < 2:
        check = np.ones(len(y), bool)
    sums = source.learned()  # what each view learns from
    bad_share = float((y[learn] == 0).mean()) if learn.any() else 0.5
    given = max(1, int(GIVEN * source.size))
    wanted = [max(1, int(given * bad_share)), max(1, int(given * (1 - bad_share)))]
    steps: list[Step] = []
    for _ in range(rounds):
        for view, other in ((TEXT, META), (META, TEXT)):
            weights = log_odds(sums[view])
            a, c = calibrate(source.scores(view, weights)[learn], y[learn].astype(float))
            steps.append(Step(view, weights, a, c))
            steps[-1] = steps[-1]._replace(cuts=cuts_of(source.levels(steps), wanted))
            sums[other] += source.sums(steps).reshape(2, BUCKETS)
    out = []
    for view in (TEXT, META):
        weights = log_odds(sums[view])
        a, c = calibrate(source.scores(view, weights)[check], y[check].astype(float))
        out.append((weights, a, c))
    prior = (y[check].sum() + 0.5) / (check.sum() + 1) if check.any() else 0.5
    return out, float(np.log(prior / (1 - prior)))


def _page_table(pages: DataFrame, id_type: str) -> DataFrame:
    """(id, pages): a page belongs to the document whose id ends its path; features of all pages of a document, added up.

    Features are added up per document and bucket before they come together, so a document holds ``BUCKETS`` entries
    at most, however many pages it has.
    """
    number = F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^?#]*/(\d+)(?:\.\w+)?/?(?:[?#]|$)", 1)
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?s)<title>(.*?)</title>", 1)
    links = F.size(F.split("html", "<a ")) - 1
    found = pages.select(number.try_cast(id_type).alias("id"), "url", title.alias("title"), links.alias("links")).where("id is not null")
    schema = pa.schema([("id", arrow_type(found, "id")), ("bucket", pa.int32()), ("n", pa.int64())])

    def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = batch.column(0).cast(schema.field("id").type)
            counts = [page_features(*page) for page in zip(*(column_values(batch, c) for c in ("url", "title", "links")))]
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(c) for c in counts]))
            buckets, n = ([x for c in counts for x in part(c)] for part in (dict.keys, dict.values))
            columns = [ids.take(at), pa.array(buckets, pa.int32()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    each = found.mapInArrow(features_of, f"id {id_type}, bucket int, n long").groupBy("id", "bucket").agg(F.sum("n").alias("n"))
    together = each.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("pages"))
    return materialize(together, "pages")


def _sample(ids: DataFrame, n: int, salt: int) -> DataFrame:
    """``n`` rows by the smallest hashes of their ids, from all rows."""
    return ids.orderBy(F.xxhash64("id", F.lit(salt)), "id").limit(n)


PACKED = ("words", "word_counts", "names", "name_counts")


def _features(docs: DataFrame, labels: DataFrame, pages: DataFrame | None, id_col: str, text_col: str, max_labelled: int) -> DataFrame:
    """(id, y, held, order, each, and ``PACKED``: both views) of every row of ``docs``.

    ``y`` is the label of the chosen labelled documents, 2 of other labelled ones and -1 of the rest. Rows that
    repeat an id share its count ``each``. Rows with a null id have no ``y``.
    """
    votes = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("double").alias("y")).where("id is not null and y in (0, 1)")
    known = votes.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    known = materialize(known.join(ids, "id", "left_semi"), "labels")
    chosen = F.broadcast(materialize(_sample(known, max_labelled, 1), "sample").select("id", "y"))  # bounded by the parameter
    known = known.select("id").join(chosen, "id", "left").select("id", F.coalesce("y", F.lit(2)).alias("y"))
    id_type = docs.schema[id_col].dataType.simpleString()
    if pages is not None:
        ids = ids.join(_page_table(pages, id_type), "id", "left")
    else:
        ids = ids.selectExpr("*", "cast(null as map<int, bigint>) pages")
    facts = materialize(ids.join(known, "id", "left").withColumn("y", F.coalesce("y", F.lit(-1))), "facts")
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        text_of(text_col).alias("text"),
    )
    id_arrow = arrow_type(rows, "id")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TextFeatures()
        for batch in sliced(batches):
            texts = column_values(batch, "text")
            sizes = pa.array([len(t) for t in texts], pa.int64())
            columns = [batch.column(0).cast(id_arrow), batch.column(1), batch.column(2), sizes, *pack([count(t) for t in texts])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang", "source", "size", "words", "word_counts"])

    def count_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns = [column_values(batch, c) for c in ("lang", "source", "size")]
            columns.append([dict(p or ()) for p in column_values(batch, "pages")])  # maps come as lists of pairs
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "y", "n", "words", "word_counts")]
            kept[0] = kept[0].cast(id_arrow)
            names = pack([meta_features(*r) for r in zip(*columns)])
            yield pa.RecordBatch.from_arrays([*kept, *names], ["id", "y", "n", "words", "word_counts", "names", "name_counts"])

    texts = rows.mapInArrow(count_words, f"id {id_type}, lang string, source string, size long, words binary, word_counts binary")
    both = texts.join(facts.hint("merge"), "id", "left").mapInArrow(
        count_names, f"id {id_type}, y int, n long, words binary, word_counts binary, names binary, name_counts binary"
    )
    held = F.crc32(F.col("id").cast("string").cast("binary")) % 1000 < HELD_OUT * 1000
    order = F.shiftrightunsigned(F.xxhash64("id", F.lit(2)), 11) / F.lit(float(1 << 53))
    found = both.select("id", "y", held.alias("held"), order.alias("order"), (1 / F.col("n")).alias("each"), *PACKED)
    return materialize(found, "features", keep=True)


def features(docs: DataFrame, *args) -> DataFrame:
    """``_features``, without the tables on the way."""
    with scratch_tables(docs.sparkSession):
        return _features(docs, *args)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[Examples]]]:
    """Pieces of the batches, of about ``ENTRIES`` features, with both views."""
    for batch in batches:
        packed = [column_values(batch, c) for c in PACKED]
        start = size = 0
        for i, (a, b) in enumerate(zip(packed[0], packed[2]), 1):
            size += len(a) + len(b)
            if size >= 2 * ENTRIES or i == batch.num_rows:
                words, counts, names, name_counts = (p[start:i] for p in packed)
                yield batch.slice(start, i - start), [Examples.packed(words, counts), Examples.packed(names, name_counts)]
                start, size = i, 0


def _floats(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.array(column_values(batch, name), float)


class OnSpark:
    """Documents as ``features`` leaves them; weights go to the tasks, sums of all tasks come back."""

    def __init__(self, rows: DataFrame):
        self.context = rows.sparkSession.sparkContext
        self.free = rows.where("y = -1")
        self.known = materialize(rows.where("y in (0, 1)").dropDuplicates(["id"]), "known")  # bounded by MAX_LABELLED
        facts = self.known.select("y", "held").orderBy("order", "id").collect()
        self.labels = np.array([r.y for r in facts], np.int64)
        self.held = np.array([r.held for r in facts], bool)
        self.size = self.free.select("id").distinct().count()

    def scores(self, view: int, weights: np.ndarray) -> np.ndarray:
        shared = self.context.broadcast(weights)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, views in _parts(batches):
                odds = pa.array(views[view].scores(shared.value), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), odds], ["id", "order", "odds"])

        kind = self.known.schema["id"].dataType.simpleString()
        found = self.known.select("id", "order", *PACKED).mapInArrow(score, f"id {kind}, order double, odds double")
        out = np.array([r.odds for r in found.orderBy("order", "id").select("odds").collect()], float)
        shared.destroy()
        return out

    def _totals(self, rows: DataFrame, count: Callable[[pa.RecordBatch, list[Examples]], np.ndarray], size: int) -> np.ndarray:
        """The sum of what ``count`` gives for all parts; each task adds up its own."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size, np.int64)
            for part in _parts(batches):
                total += count(*part)
            slots = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(total[slots], pa.int64())], ["slot", "n"])

        out = np.zeros(size, np.int64)
        for r in rows.mapInArrow(add, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
            out[r.slot] = r.n
        return out

    def learned(self) -> np.ndarray:
        def count(batch: pa.RecordBatch, views: list[Examples]) -> np.ndarray:
            y = np.array(column_values(batch, "y"), np.int64)
            return np.stack([v.sums(y, np.ones(len(y), bool)) for v in views]).ravel()

        return self._totals(self.known.where("not held").select("y", *PACKED), count, 4 * BUCKETS).reshape(2, 2, BUCKETS)

    def _over_free(self, method: str, steps: Sequence[Step], size: int) -> np.ndarray:
        shared = self.context.broadcast(list(steps))

        def count(batch: pa.RecordBatch, views: list[Examples]) -> np.ndarray:
            return getattr(Block(views, _floats(batch, "order"), _floats(batch, "each")), method)(shared.value)

        out = self._totals(self.free.select("order", "each", *PACKED), count, size)
        shared.destroy()
        return out

    def levels(self, steps: Sequence[Step]) -> np.ndarray:
        return self._over_free("levels", steps, 2 * LEVELS)

    def sums(self, steps: Sequence[Step]) -> np.ndarray:
        return self._over_free("sums", steps, 2 * BUCKETS)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    pages: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """(id, text_score, meta_score, score, kept) of every row of ``docs``.

    Scores are probabilities of good quality: of the text view, of the metadata view, and of both, whose
    log-odds are added and the prior's taken off once. ``kept`` is score >= threshold. Labels other than 0
    and 1 are left out; an id with several labels takes their majority, 1 if even. Null and empty texts score by the
    prior in the text view. Repeated rows each get a row; rows that repeat an unlabelled id teach as one document.
    Rows with a null id are scored without a page. Without
    labels all scores are the prior of one half. Null languages, sources and urls are features. Extra columns
    are not read.
    """
    rows = features(docs, labels, pages, id_col, text_col, max_labelled)
    made, prior = cotrain_on(OnSpark(rows))
    shared = docs.sparkSession.sparkContext.broadcast(made)
    id_type, id_arrow = rows.schema["id"].dataType.simpleString(), arrow_type(rows, "id")

    def score_both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, views in _parts(batches):
            odds = [a * v.scores(w) + c for v, (w, a, c) in zip(views, shared.value)]
            odds[TEXT] = np.where(views[TEXT].sizes > 0, odds[TEXT], prior)
            columns = [batch.column(0).cast(id_arrow), *[pa.array(x, pa.float64()) for x in odds]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_odds", "meta_odds"])

    both = rows.select("id", *PACKED).mapInArrow(score_both, f"id {id_type}, text_odds double, meta_odds double")

    def chance(odds: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))

    score = chance(F.col("text_odds") + F.col("meta_odds") - F.lit(prior))
    return both.select(
        F.col("id").alias(id_col),
        chance(F.col("text_odds")).alias("text_score"),
        chance(F.col("meta_odds")).alias("meta_score"),
        score.alias("score"),
        (score >= threshold).alias("kept"),
    )
