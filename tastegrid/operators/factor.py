"""Biased matrix factorisation, by alternating least squares or by stochastic gradient descent."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastegrid.functions import clip_rating, dot
from tastegrid.operators.als import fit_als
from tastegrid.operators.metrics import error_metrics
from tastegrid.operators.predict import NOT_TRAINED, BiasPredictor, global_mean
from tastegrid.operators.prepare import hash_split
from tastegrid.operators.sgd import Descent, Fit, block_of
from tastegrid.operators.similar import similar_by_vector
from tastegrid.plans.blocks import block_top_n
from tastegrid.plans.spread import label_of, slot_labels
from tastegrid.sources.session import files_by_folder, materialize, read_files, scratch_tables

# Fixed default parameters of the model.
SOLVERS = ("als", "sgd")
DEFAULTS = {"n_factors": 100, "n_epochs": 20, "lr_all": 0.005, "reg_all": 0.02, "random_state": 42}


def _block(files: list[str], key: str, bias: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rising ids, offsets and factors of a block of a written factor table."""
    if not files:
        return np.empty(0, np.int64), np.empty(0), np.empty((0, width), np.float32)
    rows = read_files(files, [key, bias, "features"]).combine_chunks()
    ids, vecs = rows[key].to_numpy(), rows["features"].combine_chunks().flatten().to_numpy().reshape(-1, width)
    order = slice(None) if (np.diff(ids) > 0).all() else np.argsort(ids)
    return ids[order], rows[bias].to_numpy()[order], vecs[order]


def _parts(users: dict, items: dict, blocks: int, salts: int, width: int, names: list[str]) -> Callable:
    """Item offset, user offset and product after the columns of pairs, which come by their blocks; their last three: user, item, slot."""

    def run(batches):
        held, sides = None, None
        for batch in batches:
            slots = batch.column(batch.num_columns - 1).to_numpy()
            starts = np.flatnonzero(np.diff(slots, prepend=-1))
            for lo, hi in zip(starts, np.append(starts[1:], len(slots))):
                place = int(slots[lo]) // salts
                if place != held:
                    held, sides = place, None  # the blocks before may go
                    kinds = (users, "userId", "user_bias"), (items, "movieId", "item_bias")
                    sides = [_block(files.get((k,), []), *keys, width) for k, (files, *keys) in zip(divmod(place, blocks), kinds)]
                rows, at, known = batch.slice(lo, hi - lo), [], []
                for (ids, _, _), column in zip(sides, rows.columns[-3:-1]):
                    values = pc.fill_null(column, 0).to_numpy()
                    near = np.minimum(np.searchsorted(ids, values), max(0, len(ids) - 1))
                    mine = column.is_valid().to_numpy(zero_copy_only=False)
                    mine = mine & (ids[near] == values) if len(ids) else np.zeros(len(values), bool)
                    at.append(near)
                    known.append(mine)
                offsets = [np.zeros(len(mine)) for mine in known]
                for out, mine, place_at, (_, bias, _) in zip(offsets, known, at, sides):
                    out[mine] = bias[place_at[mine]]
                products, both = np.zeros(len(rows)), known[0] & known[1]
                p, q = (vecs[place_at[both]].astype(np.float64) for (_, _, vecs), place_at in zip(sides, at))
                products[both] = np.einsum("lk,lk->l", p, q)
                new = [pa.array(x) for x in (offsets[1], offsets[0], products)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-3], *new], names=names)

    return run


class FactorModel:
    """mean + user offset + item offset + user factors . item factors, clipped to the scale.

    With ``solver`` "sgd" offsets and factors are learned together by stochastic gradient descent over every
    rating, with learning rate ``lr_all`` (see ``sgd.py``). With "als" the offsets are damped means (see
    ``BiasPredictor``) and the factors are fitted by alternating least squares on what the offsets leave (see
    ``als.py``); ``lr_all`` has no effect then. Unknown users or items contribute 0. With ``use_bias`` False the
    factors are fitted around the mean.

    Repeated ratings of a pair enter the factors of "als" once, with their mean; the offsets and "sgd" use every
    row. So one pair with very many rows costs "als" nothing.
    """

    def __init__(
        self,
        n_factors: int = DEFAULTS["n_factors"],
        n_epochs: int = DEFAULTS["n_epochs"],
        lr_all: float = DEFAULTS["lr_all"],
        reg_all: float = DEFAULTS["reg_all"],
        random_state: int = DEFAULTS["random_state"],
        use_bias: bool = True,
        blocks: int | None = None,
        solver: str = "als",
    ):
        if solver not in SOLVERS:
            raise ValueError(f"unknown solver {solver}")
        self.params = {
            "n_factors": int(n_factors),
            "n_epochs": int(n_epochs),
            "lr_all": lr_all,
            "reg_all": reg_all,
            "random_state": random_state,
            "use_bias": use_bias,
            "solver": solver,
        }
        self.blocks = blocks
        self.mean: float | None = None
        self.users: DataFrame | None = None
        self.items: DataFrame | None = None
        self.train_pairs: DataFrame | None = None
        self._written: tuple[dict, dict, int] | None = None
        self.metrics: dict = {}

    @classmethod
    def from_tables(cls, mean: float, users: DataFrame, items: DataFrame, pairs: DataFrame, **params) -> FactorModel:
        """A model from given factors: (userId, user_bias, features), (movieId, item_bias, features) and the rated pairs."""
        model = cls(**params)
        model.mean, model.users, model.items, model.train_pairs = mean, users, items, pairs.select("userId", "movieId")
        return model

    @property
    def trained(self) -> bool:
        return self.users is not None

    def _require(self) -> None:
        if not self.trained:
            raise ValueError(NOT_TRAINED)

    def fit(self, ratings: DataFrame) -> FactorModel:
        with scratch_tables(ratings.sparkSession):
            return self._fit_sgd(ratings) if self.params["solver"] == "sgd" else self._fit_als(ratings)

    def _fit_sgd(self, ratings: DataFrame) -> FactorModel:
        names = ("n_factors", "lr_all", "reg_all", "random_state", "use_bias")
        one = Fit(**{n: self.params[n] for n in names})
        work = Descent(ratings.select("userId", "movieId", "rating"), [one], self.params["random_state"], self.blocks)
        work.run(self.params["n_epochs"])
        self.mean = work.means[0]
        users = materialize(work.table(0, 0, "userId", "user_bias"), "userId-factors", keep=True, folders=["block"])
        items = materialize(work.table(0, 1, "movieId", "item_bias"), "movieId-factors", keep=True, folders=["block"])
        self._written = *(files_by_folder(table, ["block"]) for table in (users, items)), work.blocks
        self.users, self.items = users.drop("block"), items.drop("block")
        pairs = work.rows.select(F.col("u").alias("userId"), F.col("v").alias("movieId")).distinct()
        self.train_pairs = materialize(pairs, "train-pairs", keep=True)
        return self

    def _fit_als(self, ratings: DataFrame) -> FactorModel:
        # The offsets are the same for all rows of a pair, so they are joined to its mean.
        means = ratings.groupBy("userId", "movieId").agg(F.avg("rating").alias("rating"))
        bias = None
        if self.params["use_bias"]:
            bias = BiasPredictor().fit(ratings)
            self.mean = bias.mean
            based = bias.offsets(means)
        else:
            self.mean = global_mean(ratings)
            based = means.withColumn("base", F.lit(self.mean).cast("double"))
        rest = based.select("userId", "movieId", (F.col("rating") - F.col("base")).alias("rest"))
        pairs = materialize(rest, "train-pairs", keep=True)
        self.train_pairs = pairs.select("userId", "movieId")
        numbers = (self.params[n] for n in ("n_factors", "n_epochs", "reg_all", "random_state"))
        users, items = fit_als(pairs, *numbers, blocks=self.blocks)
        self.users = self._table(users, "userId", bias and bias.user_bias, "user_bias")
        self.items = self._table(items, "movieId", bias and bias.item_bias, "item_bias")
        return self

    def _table(self, factors: DataFrame, key: str, bias: DataFrame | None, name: str):
        keyed = factors.withColumnRenamed("id", key)
        if bias is None:
            table = keyed.withColumn(name, F.lit(0.0))
        else:
            table = bias.join(keyed, key, "left")
        return materialize(table.select(key, name, "features"), f"{key}-factors", keep=True)

    def train(self, ratings: DataFrame, test_size: float = 0.2, save_path: str | None = None) -> dict:
        """Fit on the larger part of a hash split and score the rest."""
        start = time.monotonic()
        train, test = hash_split(ratings, test_size, self.params["random_state"])
        self.fit(train)
        scores = self.evaluate(test).first()
        self.metrics = {
            "rmse": scores.rmse,
            "mae": scores.mae,
            "n_train": train.count(),
            "n_test": scores.n_test,
            "training_time": time.monotonic() - start,
        }
        if save_path:
            self.save(save_path)
        return self.metrics

    def _in_blocks(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with the parts of their estimate, by tasks that read the factors of their two blocks: no vector is sent."""
        users, items, blocks = self._written
        spark = pairs.sparkSession
        salts = ceil(spark.sparkContext.defaultParallelism / blocks**2)
        slots = blocks**2 * salts
        keyed = pairs.select("*", F.col("userId").cast("bigint").alias("__u"), F.col("movieId").cast("bigint").alias("__v"))
        salt = F.pmod(F.xxhash64("__v", "__u"), F.lit(salts)).cast("int")
        keyed = keyed.withColumn("__slot", (block_of("__u", blocks) * blocks + block_of("__v", blocks)) * salts + salt)
        label = label_of(F.col("__slot"), slot_labels(spark, slots))
        keyed = keyed.repartition(slots, label).sortWithinPartitions("__slot")
        kind = T.StructType([*pairs.schema, *[T.StructField(n, T.DoubleType()) for n in ("item_bias", "user_bias", "dot_")]])
        work = _parts(users, items, blocks, salts, self.params["n_factors"], kind.names)
        return keyed.mapInArrow(work, kind)

    def predict(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with a ``prediction`` in the rating scale."""
        self._require()
        if self._written is not None:
            scored = self._in_blocks(pairs)
        else:
            scored = pairs.join(self.items.withColumnRenamed("features", "__q"), "movieId", "left")
            scored = scored.join(self.users.withColumnRenamed("features", "__p"), "userId", "left")
            scored = scored.withColumn("dot_", dot(F.col("__p"), F.col("__q"))).drop("__p", "__q")
        zero = F.lit(0.0)
        estimate = (
            F.lit(self.mean).cast("double")
            + F.coalesce("item_bias", zero)
            + F.coalesce("user_bias", zero)
            + F.coalesce("dot_", zero)
        )
        # The columns of pairs come after the keys, as a join gives them.
        first = ["userId", "movieId"]
        names = first + [c for c in pairs.columns if c not in first]
        return scored.withColumn("prediction", clip_rating(estimate)).select(*names, "prediction")

    def evaluate(self, test: DataFrame) -> DataFrame:
        """rmse, mae and n_test over every row of ``test``."""
        return error_metrics(self.predict(test))

    def _padded(self, rows: DataFrame, key: str, last) -> DataFrame:
        """Factor vector with one more place for the item offset; zeros for unknown keys."""
        zeros = F.array_repeat(F.lit(0.0).cast("float"), self.params["n_factors"])
        vec = F.concat(F.coalesce("features", zeros), F.array(last.cast("float")))
        return rows.select(F.col(key).cast("bigint").alias("id"), vec.alias("vec"))

    def recommend(
        self,
        users: DataFrame,
        movies: DataFrame,
        n: int = 10,
        exclude_rated: bool = True,
        exclude: DataFrame | None = None,
        rows_per_block: int | None = None,
    ) -> DataFrame:
        """(userId, rank, movieId, title, genres, predicted_rating) for a table of users.

        Candidates are all catalogue items; items of the training set are left out with
        ``exclude_rated``, and the (userId, movieId) rows of ``exclude`` as well. The item
        offset rides along as one more factor. Ranked on the estimate before clipping, so
        that estimates above 5 keep their order.
        """
        self._require()
        wanted = materialize(users.select("userId").distinct(), "requested-users")
        requested = wanted.join(self.users, "userId", "left")
        catalogue = movies.select("movieId").distinct().join(self.items, "movieId", "left")
        left = self._padded(requested, "userId", F.lit(1.0))
        right = self._padded(catalogue, "movieId", F.coalesce("item_bias", F.lit(0.0)))
        seen = None
        for part in ([self.train_pairs] if exclude_rated else []) + ([exclude] if exclude is not None else []):
            rows = part.join(wanted, "userId", "left_semi").select(
                F.col("userId").alias("left_id"), F.col("movieId").alias("right_id")
            )
            seen = rows if seen is None else seen.unionByName(rows)
        best = block_top_n(left, right, n, exclude=seen, rows_per_block=rows_per_block).select(
            F.col("left_id").alias("userId"), "rank", F.col("right_id").alias("movieId"), "score"
        )
        estimate = F.lit(self.mean).cast("double") + F.coalesce("user_bias", F.lit(0.0)) + F.col("score")
        return (
            best.join(self.users.select("userId", "user_bias"), "userId", "left")
            .join(movies, "movieId", "left")
            .select(
                "userId",
                "rank",
                "movieId",
                "title",
                "genres",
                F.round(clip_rating(estimate), 2).alias("predicted_rating"),
            )
        )

    def similar(
        self, movies: DataFrame, n: int = 10, targets: DataFrame | None = None
    ) -> DataFrame:
        """Nearest items by factor cosine, with the title and genres of the neighbour."""
        self._require()
        known = self.items.where(F.col("features").isNotNull())
        best = similar_by_vector(known, n, "movieId", "features", targets)
        text = movies.select(F.col("movieId").alias("similarId"), "title", "genres")
        return best.join(text, "similarId", "left").select(
            "movieId",
            "rank",
            "similarId",
            "title",
            "genres",
            F.round("similarity", 3).alias("similarity_score"),
        )

    def save(self, path: str) -> None:
        """Offset and factor tables, training pairs, parameters and metrics as a new version under ``path``.

        The tables go to a folder of their own; a line of ``path``/manifest, committed last, makes it the current version.
        A save that fails half-way, or runs beside a load, leaves the earlier version as it is. Earlier versions stay
        until their owner deletes them.
        """
        self._require()
        version = uuid.uuid4().hex
        for name, table in (("users", self.users), ("items", self.items), ("pairs", self.train_pairs)):
            table.write.parquet(f"{path}/versions/{version}/{name}")
        facts = {**self.params, **self.metrics, "mean": self.mean}
        spark = self.users.sparkSession
        row = spark.createDataFrame([facts]).withColumn("saved_at", F.current_timestamp())
        row.write.parquet(f"{path}/versions/{version}/facts")
        line = spark.createDataFrame([(time.time_ns(), version)], "saved long, version string")
        line.coalesce(1).write.mode("append").json(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FactorModel:
        """The version of the last line of the manifest."""
        lines = spark.read.schema("saved long, version string").json(f"{path}/manifest")
        folder = f"{path}/versions/{lines.agg(F.max_by('version', F.struct('saved', 'version'))).first()[0]}"
        facts = spark.read.parquet(f"{folder}/facts").first().asDict()
        model = cls(**{k: facts[k] for k in (*DEFAULTS, "use_bias", "solver")})
        model.mean = facts["mean"]
        names = ("rmse", "mae", "n_train", "n_test", "training_time")
        model.metrics = {k: facts[k] for k in names if k in facts}
        model.users = spark.read.parquet(f"{folder}/users")
        model.items = spark.read.parquet(f"{folder}/items")
        model.train_pairs = spark.read.parquet(f"{folder}/pairs")
        return model
