"""Training jobs: window reconstructors, pattern classifier, model folders.

A reconstructor's parameters have the size of a window (steps x features) times
its components, never of the data and never window squared: its principal axes
come from a randomised range finder, whose passes add up the products of the
windows with a thin matrix.  That is all the driver and a task hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railtap.functions.risk import class_summary
from railtap.functions.scalars import stable_hash
from railtap.operators.score import calibrate, error_train, squared_errors
from railtap.schema import MISSING
from railtap.session import checkpoint

# P(N <= n) of a Poisson variable with mean 1, in millionths.
_POISSON = [367879, 735759, 919699, 981012, 996340, 999406, 999917, 999990, 999999]


@dataclass
class Reconstructor:
    """Linear reconstruction of a flattened window: x̂ = mean + P Pᵀ (x - mean) under √weight scaling.

    Several members, fitted on other draws of the same windows, reconstruct to
    the mean of what each gives.
    """
    basis: list[np.ndarray]    # cells x components, per member
    mean: list[np.ndarray]
    root: np.ndarray
    steps: int
    width: int

    def apply(self, df: DataFrame, x: str = "x", out: str = "xh") -> DataFrame:
        """Add the reconstruction of the window array ``x``; the matrix products run on Arrow batches."""
        members, root, shape = list(zip(self.basis, self.mean)), self.root, (self.steps, self.width)

        @F.pandas_udf("array<array<double>>")
        def reconstruct(flat: pd.Series) -> pd.Series:
            if len(flat) == 0:
                return pd.Series([], dtype=object)
            cells = np.stack(flat.to_numpy()).astype(np.float64)
            total = sum(_centred(cells, mean, root) @ basis @ basis.T / root + mean for basis, mean in members)
            return pd.Series(list((total / len(members)).reshape(-1, *shape).tolist()))

        return df.withColumn(out, reconstruct(F.flatten(F.col(x))))

    def save(self, path: str) -> None:
        """One row per member and cell: mean, weight and the cell's components."""
        rows = [(m, i, float(mean[i]), float(self.root[i]), self.steps, self.width, [float(v) for v in basis[i]])
                for m, (basis, mean) in enumerate(zip(self.basis, self.mean)) for i in range(len(mean))]
        SparkSession.active().createDataFrame(
            rows, "member int, pos int, mean double, root double, steps int, width int, basis array<double>") \
            .write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str) -> "Reconstructor":
        rows = SparkSession.active().read.parquet(path).orderBy("member", "pos").collect()
        of = [[r for r in rows if r["member"] == m] for m in range(rows[-1]["member"] + 1)]
        return cls([np.array([r["basis"] for r in one]) for one in of], [np.array([r["mean"] for r in one]) for one in of],
                   np.array([r["root"] for r in of[0]]), rows[0]["steps"], rows[0]["width"])


def _split(df: DataFrame, ident: str, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Hold-out split by hash of the id: the same rows on every recomputation."""
    u = stable_hash(F.concat_ws("|", F.lit(seed), F.col(ident)), 10_000) / 10_000.0
    return df.where(u >= share), df.where(u < share)


def bootstrap_weight(ident: Column, member: Column, seed: int = 42) -> Column:
    """How often a member's bootstrap sample holds a row: Poisson with mean 1, from a hash of id and member."""
    u = stable_hash(F.concat_ws("|", F.lit(seed), member.cast("string"), ident.cast("string")), 1_000_000)
    n = F.lit(0)
    for upto in _POISSON:
        n = n + (u >= upto).cast("int")
    return n


def _centred(cells: np.ndarray, mean: np.ndarray, root: np.ndarray) -> np.ndarray:
    return np.where(cells == MISSING, 0.0, cells - mean) * root


def _summed(rows: DataFrame, members: int, size: int, width: int, part: Callable) -> np.ndarray:
    """Sum over all windows of ``part(cells, weights of a member, member)``, members x size x width, in one scan."""
    names = [f"c{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            cells = batch.column("flat").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            w = batch.column("w").flatten().to_numpy().reshape(batch.num_rows, members).astype(np.float64)
            for at in range(0, len(cells), 512):   # a thin slice of wide windows at a time
                got = np.stack([part(cells[at:at + 512], w[at:at + 512, m], m) for m in range(members)])
                total = got if total is None else total + got
        if total is not None:
            flat = total.reshape(-1, width)
            at = np.arange(len(flat), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(np.ascontiguousarray(c)) for c in flat.T]], ["at", *names])

    ddl = ", ".join(["at int", *[f"{c} double" for c in names]])
    got = rows.mapInArrow(run, ddl).groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).toArrow()   # of the model's size
    out = np.zeros((members * size, width))
    out[got["at"].to_numpy()] = np.column_stack([got[c].to_numpy() for c in names]) if got.num_rows else out[:0]
    return out.reshape(members, size, width)


def _fit(df: DataFrame, x: str, steps: int, width: int, k: int, weights: list[float], member_weights: Column | None = None,
         members: int = 1, rounds: int = 4, seed: int = 7) -> Reconstructor:
    """Principal axes of every member's weighted windows, each pass over the windows serving all members.

    The axes' span is found by multiplying the covariance with a thin random
    matrix, and its own span again, ``rounds`` times in all.
    """
    n = steps * width
    k = min(k, n)
    thin = min(n, max(4 * k, k + 32))
    w = member_weights if member_weights is not None else F.array(F.lit(1))
    rows = df.select(F.flatten(F.col(x)).alias("flat"), w.alias("w"))
    root = np.tile([v ** 0.5 if v > 0 else 1e-6 for v in weights], steps)

    def moments(cells: np.ndarray, one: np.ndarray, m: int) -> np.ndarray:
        seen = cells != MISSING
        return np.column_stack([one @ np.where(seen, cells, 0.0), one @ seen])

    sums = _summed(rows, members, n, 2, moments)
    mean = sums[:, :, 0] / np.maximum(sums[:, :, 1], 1e-300)
    span = [np.linalg.qr(np.random.default_rng(seed + m).normal(size=(n, thin)))[0] for m in range(members)]
    for _ in range(rounds):
        def product(cells: np.ndarray, one: np.ndarray, m: int, span=span) -> np.ndarray:
            c = _centred(cells, mean[m], root)
            return c.T @ (one[:, None] * (c @ span[m]))

        image = _summed(rows, members, n, thin, product)
        inner = [q.T @ y for q, y in zip(span, image)]   # the covariance inside the span, before it moves on
        axes = [q @ np.linalg.eigh((t + t.T) / 2)[1][:, ::-1][:, :k] for q, t in zip(span, inner)]
        span = [np.linalg.qr(y)[0] for y in image]
    return Reconstructor(axes, list(mean), root, steps, width)


def train_reconstructor(df: DataFrame, ident: str, x: str, steps: int, width: int, k: int = 8,
                        weights: list[float] | None = None, holdout: float = 0.1, seed: int = 42):
    """Fit on all but the hold-out; returns the model, scored windows and threshold candidates of the training part."""
    weights = weights or [1.0] * width
    df = checkpoint(df.sparkSession, df.select(ident, x), "training")   # every pass of the fit reads it
    train, test = _split(df, ident, holdout, seed)
    rec = _fit(train, x, steps, width, k, weights)

    def scored(part: DataFrame, name: str) -> DataFrame:
        out = rec.apply(part, x)
        return out.select(ident, F.lit(name).alias("part"),
                          error_train(F.col(x), squared_errors(F.col(x), F.col("xh"), weights)).alias("mse"))

    errors = scored(train, "train").unionByName(scored(test, "test"))
    return rec, errors, calibrate(errors.where("part = 'train'"), "mse")


def bagged_reconstructor(df: DataFrame, ident: str, x: str, steps: int, width: int, k: int = 8, members: int = 4,
                         seed: int = 42) -> Reconstructor:
    """Several members, each on its own bootstrap draw of the windows; all draws are counted in the same passes."""
    df = checkpoint(df.sparkSession, df.select(ident, x), "training")
    draws = F.array(*[bootstrap_weight(F.col(ident), F.lit(m), seed) for m in range(members)])
    return _fit(df, x, steps, width, k, [1.0] * width, draws, members)


# --- pattern classifier --------------------------------------------------------

def pooled(rows: Column, width: int) -> Column:
    """Fixed-length summary of a compacted sequence: mean, max and last step per feature, and the length."""
    n = F.greatest(F.size(rows), F.lit(1))
    zero = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(rows, zero, lambda a, r: F.zip_with(a, r, lambda p, q: p + q))
    top = F.aggregate(rows, zero, lambda a, r: F.zip_with(a, r, lambda p, q: F.greatest(p, q)))
    last = F.coalesce(F.try_element_at(rows, F.lit(-1)), zero)
    return F.concat(F.transform(total, lambda s: s / n), top, last, F.array(n.cast("double")))


def can_stratify(df: DataFrame, label: str, n: int) -> bool:
    """At least two classes, each with ``n`` rows or more."""
    r = df.groupBy(label).count().agg(F.count(F.lit(1)).alias("c"), F.min("count").alias("m")).first()
    return (r["c"] or 0) >= 2 and (r["m"] or 0) >= n


def _strata(df: DataFrame, ident: str, label: str, parts: int, seed: int, stratify: bool) -> Column:
    """Part number by hash; stratified hashing mixes the label in, so each class is spread on its own."""
    mix = [F.lit(seed), F.col(ident)] + ([F.col(label)] if stratify else [])
    return stable_hash(F.concat_ws("|", *mix), parts).cast("int")


def train_classifier(df: DataFrame, ident: str, label: str, vector: str, folds: int = 3, holdout_parts: int = 5,
                     reg: tuple[float, ...] = (0.0, 0.01), seed: int = 42):
    """Cross-validated multinomial regression on pooled vectors.

    Returns the best pipeline, scored hold-out rows (label index, probability
    array, pattern summary) and one row per candidate with its fold average.
    """
    df = checkpoint(df.sparkSession, df.select(ident, label, vector), "training")
    strat = can_stratify(df, label, holdout_parts)
    data = df.withColumn("_v", array_to_vector(F.col(vector))) \
             .withColumn("_part", _strata(df, ident, label, holdout_parts, seed, strat))
    train, test = data.where("_part > 0"), data.where("_part = 0")
    train = train.withColumn("_fold", _strata(df, ident, label, folds, seed + 1, strat))
    index = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep").fit(data)
    reg_model = LogisticRegression(featuresCol="_v", labelCol="_y", maxIter=30)
    grid = ParamGridBuilder().addGrid(reg_model.regParam, list(reg)).build()
    cv = CrossValidator(estimator=reg_model, estimatorParamMaps=grid, numFolds=folds, foldCol="_fold",
                        evaluator=MulticlassClassificationEvaluator(labelCol="_y", metricName="f1"), parallelism=2)
    best = cv.fit(index.transform(train))
    pipe = PipelineModel([index, best.bestModel])
    scored = pipe.transform(test).withColumn("probs", vector_to_array("probability"))
    scored = scored.select(ident, label, F.col("_y").cast("int").alias("y"), "probs",
                           *[e.alias(n) for n, e in class_summary(F.col("probs")).items()])
    cv_rows = df.sparkSession.createDataFrame(
        [(float(r), float(m)) for r, m in zip(reg, best.avgMetrics)], "reg double, avg_f1 double")
    return pipe, scored, cv_rows


def best_candidate(cv_rows: DataFrame, param: str, metric: str) -> DataFrame:
    """Candidate with the best fold average."""
    return cv_rows.agg(F.max_by(param, metric).alias(param), F.max(metric).alias(metric))


def cv_summary(fold_rows: DataFrame, param: str, metrics: list[str]) -> DataFrame:
    """Mean of every metric over the folds per candidate."""
    return fold_rows.groupBy(param).agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("folds"))


def classify_with(bundle: "Bundle", width: int) -> Callable[[DataFrame], DataFrame]:
    """The ``classify`` step of serving from a stored pattern model: adds ``probs`` to windows holding ``seq``."""
    def classify(df: DataFrame) -> DataFrame:
        rows = df.withColumn("_v", array_to_vector(pooled(F.col("seq"), width)))
        out = bundle.model.transform(rows).withColumn("probs", vector_to_array("probability"))
        return out.select(*df.columns, "probs")

    return classify


def class_names(bundle: "Bundle") -> list[str]:
    """Labels of a stored pattern model in the order of its probabilities."""
    return list(bundle.model.stages[0].labels)


# --- model folders ---------------------------------------------------------------

@dataclass
class Bundle:
    """A model with what is needed to score with it."""
    model: object
    catalog: DataFrame      # pos, name, use, weight
    threshold: DataFrame    # one row of threshold candidates
    config: dict[str, str]

    def save(self, path: str) -> None:
        spark = self.catalog.sparkSession
        if isinstance(self.model, Reconstructor):
            self.model.save(f"{path}/model")
        else:
            self.model.write().overwrite().save(f"{path}/model")
        self.catalog.write.mode("overwrite").parquet(f"{path}/catalog")
        self.threshold.write.mode("overwrite").parquet(f"{path}/threshold")
        spark.createDataFrame(list(self.config.items()), "key string, value string") \
             .write.mode("overwrite").json(f"{path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str, model_class=PipelineModel) -> "Bundle":
        cfg = {r["key"]: r["value"] for r in spark.read.schema("key string, value string").json(f"{path}/config").collect()}
        return cls(model_class.load(f"{path}/model"), spark.read.parquet(f"{path}/catalog"),
                   spark.read.parquet(f"{path}/threshold"), cfg)
