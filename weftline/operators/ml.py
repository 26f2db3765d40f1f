"""Estimators, clustering, nearest neighbours, and their evaluation.

Search operators take a stated query set against all rows in blocks: the query block is broadcast (its size is checked), the
rows are scanned once, each task keeps the best k per query, and a second stage merges those. Nothing holds all pairs; in few
dimensions boxes of rows that are too far away are not compared at all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.base import EVALUATORS, MODELS, REDUCERS, SAMPLERS, Fitted, Operator
from weftline.operators.features import _hash_ranked
from weftline.session import cut, written

#: Numbers that a broadcast query block may hold: 64 MB of doubles.
MOST_QUERY_CELLS = 8_000_000
#: Neighbours that one search of :class:`NearestNeighbours` keeps in each task, over all of its queries.
MOST_FOUND = 1_000_000
#: Pairs that are compared, and numbers of rows that are held, at a time; rows of a box.
CHUNK, BOX_ROWS = 1 << 20, 256
#: Rows that the driver-side clusterers work on; a larger table is represented by so many landmarks.
MOST_LOCAL_ROWS = 5_000


# -- MLlib estimators behind one contract -----------------------------------------------------------------------------


class Estimator(Operator):
    """Fits on an array column; ``transform`` adds ``prediction`` (and ``probabilities`` where the model has them)."""

    def __init__(self, features: str = "features", label: str = "label", weight: str | None = None, output: str = "prediction", **params) -> None:
        self.features, self.label, self.weight, self.output, self.params = features, label, weight, output, params

    def build(self):
        raise NotImplementedError

    def fit(self, df: DataFrame) -> Fitted:
        made = self.build()
        if self.weight and made.hasParam("weightCol"):
            made = made.setWeightCol(self.weight)
        rows = lambda d: d.withColumn("_x", array_to_vector(F.col(self.features).cast("array<double>")))
        model = made.fit(rows(df))

        def apply(d: DataFrame) -> DataFrame:
            out = model.transform(rows(d)).withColumnRenamed("_y", self.output)
            if "_p" in out.columns:
                out = out.withColumn("probabilities", vector_to_array("_p"))
            return out.drop("_x", "_p", "_r")

        return Fitted(apply, model=model)

    def common(self) -> dict:
        return {"featuresCol": "_x", "labelCol": self.label, "predictionCol": "_y"}


def _classifier(*names: str):
    def add(make):
        cls = type(names[0].title().replace("_", ""), (Estimator,), {"build": lambda self: make(self, **self.params), "__doc__": make.__doc__})
        return MODELS.register(*names)(cls)

    return add


@_classifier("naive_bayes")
def _nb(self, smoothing: float = 1.0):
    """Multinomial naive Bayes."""
    return C.NaiveBayes(modelType="multinomial", smoothing=smoothing, rawPredictionCol="_r", probabilityCol="_p", **self.common())


@_classifier("logistic_regression")
def _lr(self, c: float = 1.0, max_iter: int = 100, n: int | None = None):
    """Multinomial logistic regression; ``n`` rows turn C into Spark's penalty 1 / (C n)."""
    return C.LogisticRegression(family="multinomial", standardization=False, regParam=1.0 / (c * n) if n else 0.0, maxIter=max_iter, rawPredictionCol="_r", probabilityCol="_p", **self.common())


@_classifier("linear_svc")
def _svc(self, reg: float = 0.01, max_iter: int = 50):
    """Linear support vectors, one against the rest."""
    return C.OneVsRest(classifier=C.LinearSVC(regParam=reg, maxIter=max_iter, featuresCol="_x", rawPredictionCol="_r"), parallelism=4, rawPredictionCol="_r", **self.common())


@_classifier("xgboost", "gbt")
def _gbt(self, rounds: int = 20, depth: int = 5, step: float = 0.1):
    """Boosted trees, one against the rest."""
    return C.OneVsRest(classifier=C.GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, seed=42, featuresCol="_x").setRawPredictionCol("_r"), parallelism=4, rawPredictionCol="_r", **self.common())


@_classifier("random_forest")
def _rf(self, trees: int = 100, depth: int = 10):
    """Random forest."""
    return C.RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=42, rawPredictionCol="_r", probabilityCol="_p", **self.common())


@_classifier("linear_regression")
def _lin(self, reg: float = 0.0):
    """Ordinary least squares by the normal equations."""
    return R.LinearRegression(solver="normal", regParam=reg, **self.common())


@_classifier("kmeans")
def _km(self, k: int = 8, max_iter: int = 300, seed: int = 42):
    """k-means; the model's ``summary.trainingCost`` is the inertia."""
    return K.KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol="_x", predictionCol="_y")


def _by_nearest(centres: np.ndarray, features: str, output: str):
    """A transform that adds the number of the nearest centre, an Arrow batch at a time."""

    def apply(d: DataFrame) -> DataFrame:
        shared = d.sparkSession.sparkContext.broadcast(centres)

        @F.pandas_udf("int")
        def nearest_centre(x: pd.Series) -> pd.Series:
            c, have = shared.value, x.notna().to_numpy()
            out = pd.Series([None] * len(x), dtype="Int32")
            if have.any():
                v = np.stack(x[have].to_numpy()).astype(float)
                out[have] = ((c**2).sum(1)[None, :] - 2 * v @ c.T).argmin(1)
            return out

        return d.withColumn(output, nearest_centre(F.col(features).cast("array<double>")))

    return apply


@MODELS.register("kmeans_mini")
class MiniBatchKMeans(Operator):
    """k-means by mini-batches: each step moves the centres towards a batch of ``batch_size`` rows, less and less the more rows a
    centre has seen. The ``steps`` batches are drawn in one scan (a sample of bounded size, a documented parameter); labelling
    covers all rows."""

    def __init__(self, features: str = "features", k: int = 8, batch_size: int = 1024, steps: int = 100, seed: int = 42, output: str = "prediction", **_) -> None:
        self.features, self.k, self.batch, self.steps, self.seed, self.output = features, k, batch_size, steps, seed, output

    def fit(self, df: DataFrame) -> Fitted:
        rows = df.select(F.col(self.features).cast("array<double>").alias("v")).where("v is not null")
        n, wanted = rows.count(), self.batch * self.steps
        sample = rows.sample(min(1.0, 1.1 * wanted / n), self.seed).limit(wanted) if n > wanted else rows
        x = np.array([r.v for r in sample.collect()], float)
        if not len(x):
            raise ValueError("there are no vectors to cluster")
        rng = np.random.default_rng(self.seed)
        # spread the first centres: each is drawn with a chance that grows with its distance from those before
        centres = [x[rng.integers(len(x))]]
        far = ((x - centres[0]) ** 2).sum(1)
        while len(centres) < min(self.k, len(x)):
            p = far / far.sum() if far.sum() > 0 else None
            centres.append(x[rng.choice(len(x), p=p)])
            far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
        c, seen = np.array(centres), np.zeros(len(centres))
        for _ in range(self.steps):
            b = x[rng.integers(len(x), size=min(self.batch, len(x)))]
            label = ((c**2).sum(1)[None, :] - 2 * b @ c.T).argmin(1)
            for j in np.unique(label):
                mine = b[label == j]
                seen[j] += len(mine)
                c[j] += (mine.mean(0) - c[j]) * len(mine) / seen[j]
        return Fitted(_by_nearest(c, self.features, self.output), centres=c)


@MODELS.register("svm")
class KernelSvm(Operator):
    """RBF support vectors, approximated by random Fourier features and a linear machine."""

    def __init__(self, features: str = "features", label: str = "label", gamma: float = 1.0, dimensions: int = 256, seed: int = 42, **params) -> None:
        self.features, self.label, self.gamma, self.dimensions, self.seed, self.params = features, label, gamma, dimensions, seed, params

    def fit(self, df: DataFrame) -> Fitted:
        width = len(df.select(self.features).first()[0])
        rng = np.random.default_rng(self.seed)
        w, b = rng.normal(0, np.sqrt(2 * self.gamma), (width, self.dimensions)), rng.uniform(0, 2 * np.pi, self.dimensions)

        @F.pandas_udf("array<double>")
        def lift(x: pd.Series) -> pd.Series:
            z = np.cos(np.stack(x.to_numpy()).astype(float) @ w + b) * np.sqrt(2 / len(b))
            return pd.Series(list(z))

        inner = MODELS.create("linear_svc", features="_z", label=self.label, **self.params).fit(df.withColumn("_z", lift(self.features)))
        return Fitted(lambda d: inner.transform(d.withColumn("_z", lift(self.features))).drop("_z"), model=inner.state["model"])


# -- nearest neighbours -----------------------------------------------------------------------------------------------


def _vectors(keys, column) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of Arrow columns, without the vectors that hold a null, NaN or infinity: those are near to nothing."""
    keys, column = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (keys, column))
    widths = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(widths) > 1 or keys.null_count:
        raise ValueError("a key is null" if keys.null_count else f"the vectors differ in width: {sorted(widths)[:5]}")
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(keys), *(widths or [0]))
    return keys.to_numpy(zero_copy_only=False), x


def _first_of_equal(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that may be among the ``k`` nearest of any query: of equal vectors the first ``k`` by id, and those of
    one id more, since one id may be the query's own."""
    order = np.lexsort((ids, *x.T[::-1]))
    i, v, place = ids[order], x[order], np.arange(len(ids))
    fresh, turn = np.ones(len(i), bool), np.ones(len(i), bool)
    fresh[1:] = (v[1:] != v[:-1]).any(1)
    turn[1:] = fresh[1:] | (i[1:] != i[:-1])
    nth = np.cumsum(turn)
    first, run = (np.maximum.accumulate(np.where(z, place, 0)) for z in (fresh, turn))
    return order[(nth - nth[first] <= k) & (place - run < k)]


def _boxes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows dealt into boxes of at most ``BOX_ROWS`` by halving along the longest side: their order, and where each box begins."""
    order, starts, todo = np.arange(len(x)), [], [(0, len(x))]
    while todo:
        a, b = todo.pop()
        if b - a <= BOX_ROWS:
            starts.append(a)
            continue
        m = (b - a) // 2
        if x.shape[1]:
            own = x[order[a:b]]
            order[a:b] = order[a:b][np.argpartition(own[:, np.ptp(own, 0).argmax()], m)]
        todo += [(a + m, b), (a, a + m)]
    return order, np.array(starts)


def _rounded(distance: np.ndarray) -> np.ndarray:
    """To nine places, halves away from zero; without effect where a double has no nine places."""
    t = distance * 1e9
    whole = np.floor(t)
    return np.where(t < 4e15, (whole + (t - whole >= 0.5)) / 1e9, distance)


class _Best:
    """The ``k`` nearest of the rows seen so far for each query, by rounded distance and id. Queries and rows lie in boxes; a box of
    rows is compared with a box of queries only if it may hold a row as near as one of those already found. Comparisons are made
    over at most ``CHUNK`` pairs at a time, so memory does not depend on how many rows there are or how many tie."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, starts: np.ndarray, k: int, exclude_self: bool) -> None:
        self.ids, self.points, self.k, self.exclude_self = ids, points, k, exclude_self
        self.spans = list(zip(starts, [*starts[1:], len(ids)]))
        none = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0), np.empty(0, object))
        self.found = [none for _ in self.spans]

    def _reach(self, box: int) -> np.ndarray:
        """Each query's rounded distance to its k-th nearest row so far; infinite where there are fewer."""
        a, b = self.spans[box]
        at, near = self.found[box][:2]
        n = np.bincount(at, minlength=b - a)
        out = np.full(b - a, np.inf)
        out[n == self.k] = near[np.cumsum(n)[n == self.k] - 1]
        return out

    def add(self, ids: np.ndarray, x: np.ndarray, carried: np.ndarray) -> None:
        if x.shape[1] != self.points.shape[1]:
            raise ValueError(f"the queries are {self.points.shape[1]} wide and the rows {x.shape[1]}")
        order, starts = _boxes(x)
        ids, x, carried = ids[order], x[order], carried[order]
        low, high, ends = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts), np.append(starts[1:], len(x))
        for box, (a, b) in enumerate(self.spans):
            q = self.points[a:b]
            gap = (np.maximum(0, np.maximum(low - q.max(0), q.min(0) - high)) ** 2).sum(1)
            by = np.argsort(gap, kind="stable")
            gap, total, at = gap[by], np.cumsum((ends - starts)[by]), 0
            while at < len(by):
                reach = self._reach(box)
                within = np.searchsorted(gap, (reach.max() + 2e-9) ** 2 * (1 + 1e-9), "right")
                if within <= at:
                    break
                rows = (total[at - 1] if at else 0) + (max(1, CHUNK // (b - a)) if np.isfinite(reach).all() else 2 * BOX_ROWS)
                upto = min(within, max(at + 1, np.searchsorted(total, rows, "right")))
                pick = np.concatenate([np.arange(starts[c], ends[c]) for c in by[at:upto]])
                self._compare(box, ids[pick], x[pick], carried[pick], reach)
                at = upto

    def _compare(self, box: int, ids: np.ndarray, x: np.ndarray, carried: np.ndarray, reach: np.ndarray) -> None:
        a, b = self.spans[box]
        q, k, width = self.points[a:b], self.k, x.shape[1]
        # squared distances by a product of matrices, less what rounding may have added; close ones are computed again exactly
        slack = 8 * (width + 4) * np.finfo(float).eps
        u, v = q - q.mean(0), x - q.mean(0)
        uu, vv = (u**2).sum(1), (v**2).sum(1)
        least = (1 - slack) * uu[:, None] + (1 - slack) * vv[None, :] - 2 * (u @ v.T)
        if self.exclude_self:
            least[self.ids[a:b, None] == ids[None, :]] = np.inf
        most = ((reach + 2e-9) * (1 + slack)) ** 2
        close = least <= most[:, None]
        if len(ids) >= k and np.count_nonzero(close) > 4 * k * len(q):
            top = np.argpartition(least, k - 1, 1)[:, :k]
            kth = (np.take_along_axis(least, top, 1) + 2 * slack * (uu[:, None] + vv[top])).max(1)
            close = least <= np.fmin(most, ((np.sqrt(np.maximum(kth, 0)) + 2e-9) * (1 + slack)) ** 2)[:, None]
        at, of = np.nonzero(close & (least < np.inf))
        if not len(at):
            return
        exact, step = np.empty(len(at)), max(1, CHUNK // max(1, width))
        for i in range(0, len(at), step):
            exact[i : i + step] = np.sqrt(((q[at[i : i + step]] - x[of[i : i + step]]) ** 2).sum(1))
        at, near, ids, exact, carried = (np.concatenate(z) for z in zip(self.found[box], (at, _rounded(exact), ids[of], exact, carried[of])))
        order = np.lexsort((ids, near, at))
        order = order[np.arange(len(at)) - np.searchsorted(at[order], at[order]) < k]
        self.found[box] = tuple(z[order] for z in (at, near, ids, exact, carried))

    def batches(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        for (a, _), (at, near, ids, exact, carried) in zip(self.spans, self.found):
            if len(at):
                columns = [pa.array(z) for z in (self.ids[a + at], ids, exact, near)] + [pa.array(carried, pa.string())]
                yield pa.record_batch(columns[: len(names)], names)


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 5, carry: str | None = None, exclude_self: bool = True) -> DataFrame:
    """The ``k`` nearest rows of each query by Euclidean distance, ties by key: ``query, neighbour, distance, rank[, carry]``."""
    block = queries.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    size = block.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0]
    if size > MOST_QUERY_CELLS:
        raise ValueError(f"the query block holds {size} numbers, at most {MOST_QUERY_CELLS} are broadcast: search it in parts")
    got = block.toArrow()
    ids, points = _vectors(got["id"], got["v"])
    ids, points = (z[np.isfinite(points).all(1)] for z in (ids, points))
    order, starts = _boxes(points)
    shared = rows.sparkSession.sparkContext.broadcast((ids[order], points[order], starts))
    columns = [F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), *([F.col(carry).cast("string").alias("c")] if carry else [])]
    schema = "query bigint, neighbour bigint, distance double, near double" + (", c string" if carry else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, held, cells = _Best(*shared.value, k, exclude_self), [], 0
        for b in batches:
            if not b.num_rows or not len(search.ids):
                continue
            ids, x = _vectors(b.column("id"), b.column("v"))
            c = np.full(len(ids), None, object)
            if carry:
                coded = b.column("c").dictionary_encode()  # equal labels of a batch are one object
                c = np.array([*coded.dictionary.to_pylist(), None], object)[pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)]
            sound = np.isfinite(x).all(1)
            held.append((ids[sound], x[sound], c[sound]))
            cells += sound.sum() * (x.shape[1] + 1)
            if cells > CHUNK:
                ids, x, c = (np.concatenate(z) for z in zip(*held))
                few = _first_of_equal(ids, x, k)
                held, cells = [(ids[few], x[few], c[few])], len(few) * (x.shape[1] + 1)
                if cells > CHUNK // 2:
                    search.add(*held.pop())
                    cells = 0
        if cells:
            ids, x, c = (np.concatenate(z) for z in zip(*held))
            few = _first_of_equal(ids, x, k)
            search.add(ids[few], x[few], c[few])
        yield from search.batches(names)

    found = rows.select(*columns).where("v is not null").mapInArrow(best, schema)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("near", "neighbour"))).where(F.col("rank") <= k).drop("near")
    return ranked.withColumnRenamed("c", carry) if carry else ranked


def knn_predict(queries: DataFrame, rows: DataFrame, key: str, vector: str, label: str, k: int = 5, exclude_self: bool = True) -> DataFrame:
    """The most frequent label among the ``k`` nearest (other) rows, ties by label: ``query, prediction``."""
    votes = nearest(queries, rows, key, vector, k, label, exclude_self).groupBy("query", label).agg(F.count(F.lit(1)).alias("n"))
    pick = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), label))
    return votes.withColumn("at", pick).where("at = 1").select("query", F.col(label).alias("prediction"))


@MODELS.register("knn")
class NearestNeighbours(Operator):
    """Classification by the ``k`` nearest training rows. Equal vectors have the same answer and are searched once. The different
    vectors are dealt into blocks that may be broadcast; the training rows are scanned once for each, so neither side is limited."""

    def __init__(self, features: str = "features", label: str = "label", k: int = 5, output: str = "prediction", **_) -> None:
        self.features, self.label, self.k, self.output = features, label, k, output

    def fit(self, df: DataFrame) -> Fitted:
        kind = df.schema[self.label].dataType
        rows = written(df.select(F.monotonically_increasing_id().alias("_row"), F.col(self.features).alias("_v"), F.col(self.label).alias("_label")), "knn-rows")

        def apply(d: DataFrame) -> DataFrame:
            queries = written(d.withColumn("_v", F.col(self.features).cast("array<double>")), "knn-queries")
            vectors = written(queries.select("_v").where("_v is not null").distinct().withColumn("_row", F.monotonically_increasing_id()), "knn-vectors")
            cells, n = vectors.agg(F.coalesce(F.sum(F.size("_v")), F.lit(0)), F.count(F.lit(1))).first()
            blocks = max(1, -(-int(cells) // (MOST_QUERY_CELLS // 2)), -(-n * self.k // MOST_FOUND))
            # with many vectors the search outweighs a shuffle that gives every core its share of the rows
            scanned = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "_row") if n > BOX_ROWS else rows
            found = None
            for b in range(blocks):
                part = vectors.where(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == b)
                got = knn_predict(part, scanned, "_row", "_v", "_label", self.k, exclude_self=False)
                got = written(got, "knn-found") if blocks > 1 else got
                found = got if found is None else found.unionAll(got)
            found = found.select(F.col("query").alias("_row"), F.col("prediction").cast(kind).alias(self.output))
            return queries.join(vectors.join(found, "_row").drop("_row"), "_v", "left").drop("_v")

        return Fitted(apply, rows=rows)


@SAMPLERS.register("smote", "smote_sampler")
class Smote:
    """Synthetic rows between a row of a small class and one of its k nearest of the class, until classes are equal.

    Every row of the class that has a vector is a seed in hashed order, again from the first when all have been taken, so
    fewer synthetic rows than seeds come from a sample of the class. Neighbours of ``most_seeds`` seeds are searched at a
    time, one scan of the class each.
    """

    def __init__(self, key: str, label: str, vector: str, k: int = 5, seed: int = 42, most_seeds: int = 2_000) -> None:
        self.key, self.label, self.vector, self.k, self.seed, self.most_seeds = key, label, vector, k, seed, most_seeds

    def resample(self, df: DataFrame) -> DataFrame:
        base = df.select(self.key, self.label, F.col(self.vector).cast("array<double>").alias(self.vector)).withColumn("synthetic", F.lit(False))
        counts = {r[0]: (r[1], r[2]) for r in base.groupBy(self.label).agg(F.count(F.lit(1)), F.count(self.vector)).collect()}
        most = max((n for n, _ in counts.values()), default=0)
        ranked, out = None, base
        for value, (rows, n) in sorted(counts.items()):
            missing = most - rows
            if missing <= 0 or n < 2:
                continue
            if ranked is None:
                ranked = written(_hash_ranked(base.where(F.col(self.vector).isNotNull()), self.key, [self.label], self.seed), "smote-seeds")
            own, k = ranked.where(F.col(self.label) == F.lit(value)), min(self.k, n - 1)
            near = None
            for first in range(0, min(missing, n), self.most_seeds):
                block = own.where((F.col("_rank") > first) & (F.col("_rank") <= min(first + self.most_seeds, missing)))
                found = nearest(block, own, self.key, self.vector, k).select("query", "neighbour", "rank")
                # of several searches each is done with before the next, so that only one block is held
                found = written(found, "smote-near") if min(missing, n) > self.most_seeds else found
                near = found if near is None else near.unionByName(found)
            # draw t belongs to the seed at t % n, and its neighbour and its way along the line come from a hash of t
            draws = df.sparkSession.range(missing).withColumn("at", F.col("id") % n + 1)
            draws = draws.withColumn("h", F.abs(F.xxhash64("id", F.lit(self.seed)))).withColumn("rank", (F.col("h") % k + 1).cast("int")).withColumn("gap", (F.col("h") % 1_000_003) / F.lit(1_000_003.0))
            a = own.select(F.col("_rank").alias("at"), F.col(self.key).alias("query"), F.col(self.vector).alias("va"))
            b = own.select(F.col(self.key).alias("neighbour"), F.col(self.vector).alias("vb"))
            made = draws.join(a, "at").join(near, ["query", "rank"]).join(b, "neighbour")
            lerp = F.transform(F.arrays_zip("va", "vb"), lambda p: p["va"] + F.col("gap") * (p["vb"] - p["va"]))
            out = out.unionByName(made.select(F.lit(None).cast(df.schema[self.key].dataType).alias(self.key), F.lit(value).alias(self.label), lerp.alias(self.vector), F.lit(True).alias("synthetic")))
        return out


# -- naive Bayes in SQL terms -----------------------------------------------------------------------------------------


def nb_predict(train: DataFrame, test: DataFrame, key: str, label: str, terms_train: DataFrame, terms_test: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """Multinomial naive Bayes over long-form terms ``key, term, tf``: class priors as observed, terms smoothed. ``key, prediction``.

    A document's score is the prior plus, for each of its terms that training saw, tf times the term's log share. The classes
    (their number, not the documents, goes to the driver) are columns of one term table that the documents' terms are joined to.
    """
    counts = written(terms_train.join(train.select(key, label), key).groupBy("term", label).agg(F.sum("tf").alias("c")), "nb-counts")
    rows = {r[0]: r[1] for r in train.groupBy(label).agg(F.count(F.lit(1))).collect()}
    n = sum(rows.values())
    priors = {c: r / n for c, r in rows.items()}
    # totals of the classes and the size of the vocabulary come from one grouped pass over the written counts
    sums = counts.groupBy("term").agg(*(F.sum(F.when(F.col(label) == F.lit(c), F.col("c"))).alias(f"t{i}") for i, c in enumerate(sorted(rows)))).agg(F.count(F.lit(1)).alias("size"), *(F.sum(f"t{i}").alias(f"t{i}") for i in range(len(rows)))).first()
    totals = {c: sums[f"t{i}"] for i, c in enumerate(sorted(rows)) if sums[f"t{i}"] is not None}
    size = sums["size"]
    classes = sorted(totals)
    # one row per term with its gain in every class, so that a document's terms are joined once and summed per class
    gain = [F.coalesce(F.sum(F.when(F.col(label) == F.lit(c), F.log((F.col("c") + smoothing) / F.lit(smoothing)))), F.lit(0.0)).alias(f"g{i}") for i, c in enumerate(classes)]
    table = counts.groupBy("term").agg(*gain)
    sums = [F.sum(F.col("tf") * F.col(f"g{i}")).alias(f"s{i}") for i in range(len(classes))]
    words = terms_test.join(table, "term").groupBy(key).agg(F.sum("tf").alias("len"), *sums)
    scored = test.select(key).join(words, key, "left")
    base = [float(np.log(smoothing / (totals[c] + smoothing * size))) for c in classes]
    scores = [
        F.struct((-F.round(F.lit(float(np.log(priors[c]))) + F.coalesce("len", F.lit(0)) * F.lit(base[i]) + F.coalesce(f"s{i}", F.lit(0.0)), 9)).alias("loss"), F.lit(c).alias("cls")) for i, c in enumerate(classes)
    ]
    # the least loss, ties by class
    return scored.select(key, F.array_min(F.array(*scores))["cls"].alias("prediction"))


# -- evaluation -------------------------------------------------------------------------------------------------------


@EVALUATORS.register("classification")
def classification_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy and class-weighted precision, recall and F1, 0 where undefined; all from the confusion counts."""
    t = df.groupBy(F.col(truth).cast("string").alias("y"), F.col(predicted).cast("string").alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    cls = t.groupBy("y").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0.0)).alias("hit"))
    said = t.groupBy(F.col("p").alias("y")).agg(F.sum("n").alias("said"))
    m = cls.join(said, "y", "left").fillna(0.0, ["said"])
    m = m.withColumn("precision", F.coalesce(F.try_divide("hit", "said"), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("hit", "support"), F.lit(0.0)))
    m = m.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    return m.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), weighted("precision"), weighted("recall"), weighted("f1"))


def class_moments(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Per class: size, mean vector and mean squared length. Partial sums, nothing gathered."""
    long = df.select(F.col(label).alias("cls"), F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    per = long.groupBy("cls", "i").agg(F.avg("x").alias("m"), F.sum(F.col("x") * F.col("x")).alias("ss"), F.count(F.lit(1)).alias("n"))
    one = per.groupBy("cls").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "m"))).alias("ms"), F.sum("ss").alias("ss"))
    return one.select("cls", "n", F.transform("ms", lambda s: s["m"]).alias("mean"), (F.col("ss") / F.col("n")).alias("length2"))


def silhouette_squared(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """Silhouette of every row under squared Euclidean distance, exact, in time linear in the rows: ``key, silhouette``.

    The mean squared distance from x to a class is |x|^2 - 2 x.m + mean|y|^2, so the class moments suffice.
    """
    moments = class_moments(df, label, vector).collect()
    if len(moments) < 2:
        return df.select(key, F.lit(0.0).alias("silhouette")).limit(0)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, y: s + y)
    rows = df.select(F.col(key), F.col(label).alias("cls"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("l2", dot(F.col("v"), F.col("v")))
    table = F.array(*(F.struct(F.lit(m.cls).alias("cls"), F.lit(m.n).alias("n"), F.array(*map(F.lit, m["mean"])).alias("m"), F.lit(m.length2).alias("l2")) for m in moments))
    far = rows.withColumn("d", F.transform(table, lambda c: F.struct(c["cls"].alias("cls"), c["n"].alias("n"), (F.col("l2") - 2 * dot(F.col("v"), c["m"]) + c["l2"]).alias("d"))))
    own = F.get(F.filter("d", lambda c: c["cls"] == F.col("cls")), F.lit(0))
    a = F.try_divide(own["d"] * own["n"], own["n"] - 1)
    b = F.array_min(F.transform(F.filter("d", lambda c: c["cls"] != F.col("cls")), lambda c: c["d"]))
    return far.select(key, F.when(own["n"] > 1, F.try_divide(b - a, F.greatest(a, b))).otherwise(0.0).alias("silhouette"))


def silhouette_of(queries: DataFrame, rows: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """Euclidean silhouette of the rows of a query block against all rows: ``key, silhouette``; same bounds as :func:`nearest`."""
    block = queries.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("string").alias("cls"), F.col(vector).cast("array<double>").alias("v"))
    if (block.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0]) > MOST_QUERY_CELLS:
        raise ValueError("the query block is too large to broadcast: evaluate it in parts")
    got = block.collect()
    shared = rows.sparkSession.sparkContext.broadcast((np.array([r.id for r in got], np.int64), np.array([r.v for r in got], float)))
    own = {r.id: r.cls for r in got}

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, q = shared.value
        for b in batches:
            if len(b) and len(qid):
                x = np.stack(b["v"].to_numpy())
                d = np.sqrt(np.maximum((q**2).sum(1)[:, None] - 2 * q @ x.T + (x**2).sum(1)[None, :], 0))
                d[qid[:, None] == b["id"].to_numpy()[None, :]] = 0
                for cls, at in b.groupby("c").indices.items():
                    yield pd.DataFrame({"id": qid, "cls": cls, "s": d[:, at].sum(1), "n": len(at)})

    all_rows = rows.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("string").alias("c"), F.col(vector).cast("array<double>").alias("v"))
    total = all_rows.mapInPandas(sums, "id bigint, cls string, s double, n bigint").groupBy("id", "cls").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    mine = queries.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("string").alias("own"))
    del own
    t = total.join(mine, "id").groupBy("id").agg(
        F.max(F.when(F.col("cls") == F.col("own"), F.try_divide("s", F.col("n") - 1))).alias("a"), F.min(F.when(F.col("cls") != F.col("own"), F.col("s") / F.col("n"))).alias("b")
    )
    return t.select(F.col("id").alias(key), F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))


def cluster_centres(df: DataFrame, label: str, vector: str) -> DataFrame:
    return class_moments(df, label, vector).select(F.col("cls").alias(label), "n", F.col("mean").alias("centre"))


@EVALUATORS.register("clustering_quality")
def clustering_quality(df: DataFrame, label: str = "cluster", vector: str = "features", key: str | None = None, metrics: Sequence[str] = ("silhouette_average",)) -> DataFrame:
    """``metric, value``: silhouette average (squared Euclidean, exact), inertia, clusters, noise share. Noise (-1) is left out of the first three."""
    rows = df.where(F.col(vector).isNotNull())
    kept = rows.where(F.col(label) != -1)
    moments = class_moments(kept, label, vector)
    size = lambda m: F.aggregate(m, F.lit(0.0), lambda s, x: s + x * x)
    base = moments.agg(F.count(F.lit(1)).cast("double").alias("n_clusters"), F.sum(F.col("n") * (F.col("length2") - size(F.col("mean")))).alias("inertia"))
    noise = rows.agg(F.avg((F.col(label) == -1).cast("double")).alias("noise_share"))
    out = base.select(F.lit(1).alias("k"), "*").join(noise.select(F.lit(1).alias("k"), "*"), "k").drop("k").unpivot([], ["n_clusters", "inertia", "noise_share"], "metric", "value")
    if any(m.startswith("silhouette") for m in metrics):
        keyed = kept if key else kept.withColumn("_key", F.lit(0))
        scores = silhouette_squared(keyed, key or "_key", label, vector)
        out = out.unionByName(scores.agg(F.avg("silhouette").alias("value")).select(F.lit("silhouette_average").alias("metric"), "value"))
    return out


@EVALUATORS.register("cluster_profile")
def cluster_profile(df: DataFrame, label: str = "cluster", numeric: Sequence[str] | None = None, indicators: Sequence[str] = (), ranking_by: str | None = None) -> dict[str, DataFrame]:
    """Number profiles, prevalence of indicators and a ranking of the clusters."""
    from weftline.operators import profile

    numeric = [c for c in (numeric or profile.numeric_columns(df)) if c != label]
    out = {"numeric_summary": profile.group_profile(df, label, numeric)} if numeric else {}
    indicators = list(indicators) or profile.indicator_columns(df)
    if indicators:
        out["prevalence"] = profile.prevalence(df, label, indicators)
    if ranking_by:
        out["ranking"] = profile.ranking(df, label, ranking_by)
    return out


@EVALUATORS.register("clustering")
def clustering_evaluation(df: DataFrame, label: str = "cluster", vector: str = "features", key: str | None = None, metrics: Sequence[str] = ("silhouette_average", "elbow", "descriptive_stats"), numeric: Sequence[str] | None = None, k_max: int = 10) -> dict[str, DataFrame]:
    """Quality, elbow and profile in one."""
    out = {"quality": clustering_quality(df, label, vector, key, metrics)} if any(m.startswith("silhouette") for m in metrics) else {}
    if "silhouette_per_point" in metrics and key:
        out["silhouettes"] = silhouette_squared(df.where(F.col(label) != -1), key, label, vector)
    if "elbow" in metrics:
        out["elbow"] = elbow(df.where(F.col(vector).isNotNull()), vector, k_max=k_max)
    if "descriptive_stats" in metrics:
        out |= cluster_profile(df, label, numeric)
    return out


@EVALUATORS.register("elbow")
def elbow(df: DataFrame, vector: str, k_min: int = 2, k_max: int = 10, seed: int = 42) -> DataFrame:
    """Inertia of each k, and the k two places after the start of the sharpest bend: ``k, inertia, best``."""
    rows, ks, inertia = cut(df.select(vector)), list(range(k_min, k_max + 1)), []
    for k in ks:
        inertia.append(float(MODELS.create("kmeans", features=vector, k=k, max_iter=20, seed=seed).fit(rows).state["model"].summary.trainingCost))
    bend = np.abs(np.diff(inertia, 2))
    best = ks[min(int(bend.argmax()) + 2, len(ks) - 1)] if len(bend) else ks[0]
    return df.sparkSession.createDataFrame([(k, i, k == best) for k, i in zip(ks, inertia)], "k int, inertia double, best boolean")


# -- clusterers without a distributed counterpart: bounded tables only ------------------------------------------------


class _Landmarks(Operator):
    """A clusterer of bounded tables as an operator on tables of any size.

    Up to MOST_LOCAL_ROWS rows are clustered themselves; of a larger table so many k-means centres are, and each row takes its
    nearest centre's cluster. Rows that were not fitted take that of the nearest fitted row or centre.
    """

    def __init__(self, features: str = "features", output: str = "prediction", seed: int = 42, **params) -> None:
        self.features, self.output, self.seed, self.params = features, output, seed, params

    def local(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Columns by name; ``cluster`` is the label."""
        raise NotImplementedError

    def fit(self, df: DataFrame) -> Fitted:
        rows = df.select(F.col(self.features).cast("array<double>").alias("v")).where("v is not null")
        got = rows.limit(MOST_LOCAL_ROWS + 1).collect()
        if len(got) > MOST_LOCAL_ROWS:
            x = MiniBatchKMeans("v", MOST_LOCAL_ROWS // 5, seed=self.seed).fit(rows).state["centres"]
        else:
            x = np.array([r.v for r in got], float)
        if not len(x):
            raise ValueError("there are no vectors to cluster")
        found = self.local(x)
        labels = {self.output if c == "cluster" else c: v for c, v in found.items()}
        at = _by_nearest(x, self.features, "_at")

        def apply(d: DataFrame) -> DataFrame:
            table = d.sparkSession.createDataFrame(pd.DataFrame({"_at": np.arange(len(x), dtype=np.int32)} | labels))
            return at(d).join(F.broadcast(table), "_at", "left").drop("_at")  # MOST_LOCAL_ROWS rows at most

        return Fitted(apply, landmarks=x, labels=found)


@MODELS.register("agglomerative")
class Agglomerative(_Landmarks):
    """Hierarchical clusters: ward, average, complete or single linkage."""

    def local(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {"cluster": hierarchy(x, **{"n_clusters": 2} | self.params).astype(np.int32)}


@MODELS.register("hdbscan")
class DensityClusters(_Landmarks):
    """Density clusters; noise is -1. Also ``probability``, ``persistence`` and ``outlier_score`` of each row."""

    def local(self, x: np.ndarray) -> dict[str, np.ndarray]:
        labels, prob, persist, outlier = density(x, **self.params)
        return {"cluster": labels.astype(np.int32), "probability": prob, "persistence": persist, "outlier_score": outlier}


def _local(df: DataFrame, key: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    got = df.select(F.col(key).cast("bigint"), F.col(vector).cast("array<double>")).orderBy(key).limit(MOST_LOCAL_ROWS + 1).collect()
    if len(got) > MOST_LOCAL_ROWS:
        raise ValueError(f"this clusterer takes at most {MOST_LOCAL_ROWS} rows: cluster centroids of a first pass instead")
    return np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], float)


def _spanning_tree(dist) -> list[tuple[float, int, int]]:
    """Prim's tree over rows given by ``dist(i) -> distances to all``."""
    first = dist(0)
    n = len(first)
    best, near, out, done = first.copy(), np.zeros(n, int), [], np.zeros(n, bool)
    done[0] = True
    for _ in range(n - 1):
        j = int(np.where(done, np.inf, best).argmin())
        out.append((float(best[j]), int(near[j]), j))
        done[j] = True
        d = dist(j)
        closer = ~done & (d < best)
        best[closer], near[closer] = d[closer], j
    return sorted(out)


def _merge(edges: Sequence[tuple[float, int, int]], n: int, stop) -> np.ndarray:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left = n
    for w, a, b in edges:
        if stop(w, left):
            break
        parent[find(a)] = find(b)
        left -= 1
    roots = [find(i) for i in range(n)]
    order = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    return np.array([order[r] for r in roots])


@REDUCERS.register("umap")
class NeighbourLayout(Operator):
    """A low-dimensional layout of the fuzzy neighbour graph (spectral, no stochastic refinement).

    Same contract as a manifold reducer, not the same numbers. The graph is that of at most ``most`` landmarks, all rows of a
    small table or a random sample of a larger one; every row, fitted or new, is placed among its nearest landmarks. Missing
    values among the landmarks raise; a row without vector has no place.
    """

    def __init__(self, column: str, key: str | None = None, n_components: int = 2, n_neighbors: int = 15, output: str = "umap", most: int = 2_000, seed: int = 42) -> None:
        self.column, self.key, self.k, self.near, self.output, self.most, self.seed = column, key, n_components, n_neighbors, output, most, seed

    def fit(self, df: DataFrame) -> Fitted:
        rows = df.select(F.col(self.column).cast("array<double>").alias("v")).where("v is not null")
        x = np.array([r.v for r in rows.orderBy(F.xxhash64("v", F.lit(self.seed))).limit(self.most).collect()], float)
        if not len(x):
            raise ValueError("there are no vectors to lay out")
        if not np.isfinite(x).all():
            raise ValueError("the vectors hold missing values")
        n, k = len(x), min(self.near, max(len(x) - 1, 1))
        sq = np.maximum((x**2).sum(1)[:, None] - 2 * x @ x.T + (x**2).sum(1)[None, :], 0)
        np.fill_diagonal(sq, np.inf)
        near = np.argsort(sq, 1)[:, :k] if n > 1 else np.zeros((n, 0), int)
        d = np.sqrt(np.take_along_axis(sq, near, 1)) if n > 1 else np.zeros((n, 0))
        w = np.zeros((n, n))
        if n > 1:
            # weights fall from 1 at the nearest row; the scale makes each row's weights sum to log2(k)
            gap, scale = d - d[:, :1], np.maximum(d.mean(1, keepdims=True), 1e-12)
            np.put_along_axis(w, near, np.exp(-gap / scale), 1)
        w = w + w.T - w * w.T
        degree = np.maximum(w.sum(1), 1e-12)
        lap = np.eye(n) - w / np.sqrt(degree[:, None] * degree[None, :])
        _, vectors = np.linalg.eigh(lap)
        at = vectors[:, 1 : self.k + 1]
        at = np.pad(at, ((0, 0), (0, self.k - at.shape[1])))

        def apply(d: DataFrame) -> DataFrame:
            shared = d.sparkSession.sparkContext.broadcast((x, at))

            @F.pandas_udf("array<double>")
            def place(v: pd.Series) -> pd.Series:
                marks, where = shared.value
                have = v.notna().to_numpy()
                out = pd.Series([None] * len(v), dtype=object)
                if have.any():
                    q = np.stack(v[have].to_numpy()).astype(float)
                    sq = np.maximum((q**2).sum(1)[:, None] - 2 * q @ marks.T + (marks**2).sum(1)[None, :], 0)
                    few = np.argpartition(sq, min(2, len(marks) - 1), 1)[:, :3]
                    weight = 1 / (np.take_along_axis(sq, few, 1) + 1e-9)
                    places = (where[few] * (weight / weight.sum(1, keepdims=True))[:, :, None]).sum(1)
                    out[have] = pd.Series(list(places), index=out.index[have])
                return out

            return d.withColumn(self.output, place(F.col(self.column).cast("array<double>")))

        return Fitted(apply, landmarks=x, layout=at)


def hierarchy(x: np.ndarray, n_clusters: int = 2, linkage: str = "ward") -> np.ndarray:
    """Cluster numbers of ``n_clusters`` hierarchical clusters. Merges are found along chains of nearest neighbours, so the time
    is quadratic in the rows."""
    n = len(x)
    if linkage == "single":
        return _merge(_spanning_tree(lambda i: np.sqrt(((x - x[i]) ** 2).sum(1))), n, lambda w, left: left <= n_clusters)
    if linkage not in ("ward", "average", "complete"):
        raise ValueError(f"unknown linkage {linkage!r}")
    sq = np.maximum((x**2).sum(1)[:, None] - 2 * x @ x.T + (x**2).sum(1)[None, :], 0)
    d = sq if linkage == "ward" else np.sqrt(sq)
    np.fill_diagonal(d, np.inf)
    size, alive, merges, chain = np.ones(n), np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain = [int(alive.argmax())]
        i = chain[-1]
        j = int(d[i].argmin())
        if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
            j = chain[-2]
        else:
            chain.append(j)
            continue
        chain = chain[:-2]
        merges.append((float(d[i, j]), i, j))
        a, b = size[i], size[j]
        if linkage == "ward":
            new = ((a + size) * d[i] + (b + size) * d[j] - size * d[i, j]) / (a + b + size)
        elif linkage == "average":
            new = (a * d[i] + b * d[j]) / (a + b)
        else:
            new = np.maximum(d[i], d[j])
        new[~alive], new[i], new[j] = np.inf, np.inf, np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j], alive[j], size[i] = np.inf, np.inf, False, a + b
    return _merge(sorted(merges, key=lambda m: m[0]), n, lambda w, left: left <= n_clusters)


def agglomerative(df: DataFrame, key: str, vector: str, n_clusters: int = 2, linkage: str = "ward") -> DataFrame:
    """Hierarchical clusters of at most MOST_LOCAL_ROWS rows by key: ``key, cluster``; the registered operator takes any number."""
    ids, x = _local(df, key, vector)
    if not len(x):
        return df.select(key, F.lit(0).alias("cluster")).limit(0)
    return df.sparkSession.createDataFrame(pd.DataFrame({key: ids, "cluster": hierarchy(x, n_clusters, linkage).astype(int)}))


def density_clusters(df: DataFrame, key: str, vector: str, min_cluster_size: int = 5, min_samples: int | None = None) -> DataFrame:
    """Density clusters of at most MOST_LOCAL_ROWS rows by key: ``key, cluster (-1: noise), probability, persistence, outlier_score``."""
    ids, x = _local(df, key, vector)
    if not len(x):
        zero = F.lit(0.0)
        return df.select(key, F.lit(-1).alias("cluster"), zero.alias("probability"), zero.alias("persistence"), zero.alias("outlier_score")).limit(0)
    labels, prob, persist, outlier = density(x, min_cluster_size, min_samples)
    return df.sparkSession.createDataFrame(pd.DataFrame({key: ids, "cluster": labels.astype(int), "probability": prob, "persistence": persist, "outlier_score": outlier}))


def density(x: np.ndarray, min_cluster_size: int = 5, min_samples: int | None = None) -> tuple[np.ndarray, ...]:
    """Labels, probabilities, persistence and outlier scores by mutual reachability and cluster stability."""
    n, k = len(x), min_samples or min_cluster_size
    if n <= min_cluster_size:
        return np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n)
    core = np.array([np.partition(np.sqrt(((x - p) ** 2).sum(1)), min(k, n - 1))[min(k, n - 1)] for p in x])
    edges = _spanning_tree(lambda i: np.maximum(np.maximum(np.sqrt(((x - x[i]) ** 2).sum(1)), core), core[i]))
    # single-linkage tree, children before parents
    kids, height, weight, top = {}, {}, {i: 1 for i in range(n)}, list(range(n))
    root_of = list(range(n))

    def find(a: int) -> int:
        while root_of[a] != a:
            root_of[a] = root_of[root_of[a]]
            a = root_of[a]
        return a

    node = n
    for w, a, b in edges:
        ra, rb = find(a), find(b)
        kids[node], height[node], weight[node] = (top[ra], top[rb]), w, weight[top[ra]] + weight[top[rb]]
        root_of[rb] = ra
        top[ra] = node
        node += 1

    def leaves(a: int) -> list[int]:
        out, todo = [], [a]
        while todo:
            c = todo.pop()
            out.append(c) if c < n else todo.extend(kids[c])
        return out

    # condense: (cluster, point or child cluster, lambda, size)
    birth, parent_of, members, stability, child_clusters = {0: 0.0}, {}, {0: {}}, {0: 0.0}, {0: []}
    todo, fresh = [(node - 1, 0)], 1
    while todo:
        at, c = todo.pop()
        lam = 1 / max(height[at], 1e-12) if at >= n else np.inf
        big = [s for s in kids[at] if weight[s] >= min_cluster_size]
        for s in kids[at]:
            if s not in big:
                for p in leaves(s):
                    members[c][p] = lam
        if len(big) == 2:
            for s in big:
                birth[fresh], parent_of[fresh], members[fresh], child_clusters[fresh] = lam, c, {}, []
                child_clusters[c].append((fresh, lam, weight[s]))
                todo.append((s, fresh))
                fresh += 1
        elif len(big) == 1:
            todo.append((big[0], c))
    finite = max((v for m in members.values() for v in m.values() if np.isfinite(v)), default=1.0)
    cap = lambda v: min(v, finite)
    chosen, value = {}, {}
    for c in range(fresh - 1, -1, -1):
        stability[c] = sum(cap(v) - birth[c] for v in members[c].values()) + sum((lam - birth[c]) * w for _, lam, w in child_clusters[c])
        below = sum(value[k_] for k_, _, _ in child_clusters[c])
        chosen[c] = c != 0 and stability[c] >= below
        value[c] = stability[c] if chosen[c] else below
    labels, prob, persist = np.full(n, -1), np.zeros(n), np.zeros(n)
    number = 0
    for c in range(1, fresh):
        a = parent_of[c]
        covered = False
        while a in parent_of or a == 0:
            covered |= chosen.get(a, False)
            if a == 0:
                break
            a = parent_of[a]
        if chosen[c] and not covered:
            inside, todo_c = {}, [c]
            while todo_c:
                q = todo_c.pop()
                inside.update(members[q])
                todo_c.extend(k_ for k_, _, _ in child_clusters[q])
            peak = max(cap(v) for v in inside.values())
            for p, v in inside.items():
                labels[p], prob[p], persist[p] = number, cap(v) / peak if peak else 0.0, stability[c]
            number += 1
    # how much sooner a point leaves its cluster than the densest point below that cluster does
    outlier, deepest = np.zeros(n), {}
    for c in range(fresh - 1, -1, -1):
        deepest[c] = max([cap(v) for v in members[c].values()] + [deepest[q] for q, _, _ in child_clusters[c]], default=0.0)
        for p, v in members[c].items():
            outlier[p] = 1 - cap(v) / deepest[c] if deepest[c] else 0.0
    return labels, prob, persist, outlier
