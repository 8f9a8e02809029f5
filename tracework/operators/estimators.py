"""Anomaly scores and kernel classifiers as Spark ML estimators: fitted once, saved, loaded elsewhere, applied to batches and streams.

Every estimator takes an array column (``inputCol``), learns its scaling from the rows it is fitted on, and returns a model whose state is
a few named arrays of a size that does not depend on the data.  ``model.write().save(path)`` stores parameters and arrays (a Parquet table),
``read().load(path)`` brings them back, also inside a ``PipelineModel``; ``transform`` adds a column row by row, so it works on streams.
Rows whose array is null or of another length get a null result.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations_with_replacement
from math import comb, factorial, prod, sqrt
from threading import Lock

import numpy as np
import pandas as pd
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tracework.session import materialise

PCA_SHARE = 0.95
TREES, SUBSAMPLE = 300, 256
HIDDEN = (64, 32, 8, 32, 64)
#: Weight rows of an epoch that one task adds up at most.
LANES = 64
#: Numbers of training rows that a task keeps from epoch to epoch at most (32 MB).
HELD = 1 << 22
#: Standard deviations below this count as this.
FLOOR = 1e-12


class _Turns:
    """A lock that may travel with this module: a copy is a new one."""

    def __init__(self):
        self.lock = Lock()

    def __reduce__(self):
        return _Turns, ()


#: Spark decomposes on the driver with routines that keep static values: two at a time fail to converge or give wrong components.
DECOMPOSING = _Turns()


def _param(name: str, doc: str, kind) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=kind)


# --- saved state -----------------------------------------------------------------------------

class _Writer(MLWriter):
    def __init__(self, model: ArrayModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        rows = [(name, list(a.shape), a.ravel().tolist()) for name, a in self.model.arrays.items()]
        self.sparkSession.createDataFrame(rows, "name string, shape array<int>, cells array<double>").coalesce(1).write.parquet(f"{path}/arrays")


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> ArrayModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind({r["name"]: np.array(r["cells"], float).reshape(r["shape"]) for r in self.sparkSession.read.parquet(f"{path}/arrays").collect()})
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class ArrayModel(Model, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    """A model that is a dictionary of arrays and a function of a batch of rows."""

    def __init__(self, arrays: dict[str, np.ndarray] | None = None):
        super().__init__()
        self.arrays = dict(arrays or {})

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def read(cls) -> _Reader:
        return _Reader(cls)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """One number, or one row of numbers, per row of ``x``."""
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        model = df.sparkSession.sparkContext.broadcast(self)
        width = len(self.arrays["mean"])
        many = isinstance(self.kind, ArrayType)

        @F.pandas_udf(self.kind)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            net = model.value
            for s in batches:
                good = np.array([v is not None and len(v) == width for v in s], bool)
                out = pd.Series([None] * len(s), dtype=object if many else "float64")
                if good.any():
                    got = net.apply(np.stack([np.asarray(v, float) for v in s[good]]))
                    out[good] = pd.Series(list(got), index=s.index[good]) if many else got
                yield out

        return df.withColumn(self.getOutputCol(), run(F.col(self.getInputCol()).cast(ArrayType(DoubleType()))))

    kind = DoubleType()

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.arrays["mean"]) / self.arrays["deviation"]


class ArrayEstimator(Estimator, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Base of the estimators below; keyword arguments are parameters."""

    def __init__(self, **params):
        super().__init__()
        self._setDefault(inputCol="x", outputCol="score", seed=42)
        self._set(**params)

    def _made(self, model: ArrayModel) -> ArrayModel:
        model._resetUid(self.uid)
        return self._copyValues(model)

    def _numbers(self, df: DataFrame) -> DataFrame:
        return df.select(F.col(self.getInputCol()).cast(ArrayType(DoubleType())).alias("x")).where("x is not null")


def scaling(rows: DataFrame) -> dict[str, np.ndarray]:
    """Mean and population standard deviation of the elements of the array column ``x``."""
    s = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector("x"))
    r = rows.select(s.alias("s")).select("s.count", vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance")).first()
    if not r["count"]:
        raise ValueError("no rows to fit on")
    n = r["count"]
    return {"mean": np.array(r["mean"]), "deviation": np.maximum(np.sqrt(np.array(r["variance"]) * (n - 1) / n), FLOOR)}


def scale(x: str, arrays: dict[str, np.ndarray]):
    """Scaled array column, on the JVM."""
    pairs = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(d)).alias("d")) for m, d in zip(arrays["mean"], arrays["deviation"], strict=True)])
    return F.zip_with(x, pairs, lambda v, p: (v - p["m"]) / p["d"])


# --- scaling ---------------------------------------------------------------------------------

class ArrayScalerModel(ArrayModel):
    kind = ArrayType(DoubleType())

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x)


class ArrayScaler(ArrayEstimator):
    """Standardise array elements with mean and population deviation of the rows it is fitted on (the training or good rows alone)."""

    def _fit(self, df: DataFrame) -> ArrayScalerModel:
        return self._made(ArrayScalerModel(scaling(self._numbers(df))))


# --- reconstruction by principal components ----------------------------------------------------

class PcaReconstructionModel(ArrayModel):
    def apply(self, x: np.ndarray) -> np.ndarray:
        """Mean squared error of the reconstruction: the squared length less the squared projection, as components are orthonormal."""
        z = self.scaled(x)
        return np.maximum(((z**2).sum(1) - ((z @ self.arrays["components"]) ** 2).sum(1)) / z.shape[1], 0.0)


class PcaReconstruction(ArrayEstimator):
    share = _param("share", "variance that the kept components explain", TypeConverters.toFloat)

    def __init__(self, **params):
        super().__init__()
        self._setDefault(share=PCA_SHARE)
        self._set(**params)

    def _fit(self, df: DataFrame) -> PcaReconstructionModel:
        rows = self._numbers(df)
        arrays = scaling(rows)
        z = rows.select(array_to_vector(scale("x", arrays)).alias("z"))
        with DECOMPOSING.lock:
            model = PCA(k=len(arrays["mean"]), inputCol="z", outputCol="pc").fit(z)
        explained = np.cumsum(model.explainedVariance.toArray())
        k = min(len(explained), int(np.searchsorted(explained, self.getOrDefault(self.share), side="right")) + 1)
        return self._made(PcaReconstructionModel(arrays | {"components": model.pc.toArray()[:, :k]}))


# --- isolation forest ------------------------------------------------------------------------

class IsolationForestModel(ArrayModel):
    def apply(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 for rows that few cuts isolate."""
        from tracework.operators.models import _expected_depth

        z, feature, cut, path = self.scaled(x), self.arrays["feature"].astype(np.int32), self.arrays["cut"], self.arrays["path"]
        total, rows = np.zeros(len(z)), np.arange(len(z))
        for t in range(len(feature)):
            at = np.zeros(len(z), np.int64)
            while True:
                c = feature[t, at]
                live = c >= 0
                if not live.any():
                    break
                at = np.where(live, 2 * at + 1 + (z[rows, np.maximum(c, 0)] >= cut[t, at]), at)
            total += path[t, at]
        return np.exp2(-total / len(feature) / float(_expected_depth(self.arrays["sample"][0])))


class IsolationForest(ArrayEstimator):
    """Trees over hash-chosen rows; ``idCol`` names the rows, so reruns choose the same ones."""

    idCol = _param("idCol", "column that identifies a row", TypeConverters.toString)
    trees = _param("trees", "number of trees", TypeConverters.toInt)
    sample = _param("sample", "rows that a tree sees at most", TypeConverters.toInt)

    def __init__(self, **params):
        super().__init__()
        self._setDefault(idCol="id", trees=TREES, sample=SUBSAMPLE)
        self._set(**params)

    def _fit(self, df: DataFrame) -> IsolationForestModel:
        from tracework.operators.models import forest

        get = self.getOrDefault
        rows = df.select(F.col(get(self.idCol)).alias("id"), F.col(self.getInputCol()).cast(ArrayType(DoubleType())).alias("x")).where("x is not null")
        arrays = scaling(rows)
        size = min(get(self.sample), rows.count())
        # trees x (2 * sample) nodes at most, whatever the table
        nodes = forest(rows.select("id", scale("x", arrays).alias("z")), "id", "z", get(self.trees), size, self.getSeed()).toPandas()
        slot = nodes["tree"].rank(method="dense").astype(int).to_numpy() - 1
        shape = (slot.max() + 1, int(nodes["node"].max()) + 1)
        arrays["feature"], arrays["cut"], arrays["path"] = np.full(shape, -1.0), np.zeros(shape), np.zeros(shape)
        for name in ("feature", "cut", "path"):
            arrays[name][slot, nodes["node"]] = nodes[name]
        arrays["sample"] = np.array([float(size)])
        return self._made(IsolationForestModel(arrays))


# --- autoencoder -----------------------------------------------------------------------------

def _layers(flat: np.ndarray, dims: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(dims, dims[1:], strict=False):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _forward(layers, x: np.ndarray) -> list[np.ndarray]:
    acts = [x]
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        acts.append(np.maximum(x, 0) if i < len(layers) - 1 else x)
        x = acts[-1]
    return acts


def _gradient(layers, x: np.ndarray) -> np.ndarray:
    """Of the mean squared reconstruction error of a batch, all weights in one row."""
    acts = _forward(layers, x)
    delta = 2 * (acts[-1] - x) / x.size
    parts: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        parts = [(acts[i].T @ delta).ravel(), delta.sum(0), *parts]
        if i:
            delta = (delta @ layers[i][0].T) * (acts[i] > 0)
    return np.concatenate(parts)


class AutoEncoderModel(ArrayModel):
    def apply(self, x: np.ndarray) -> np.ndarray:
        z = self.scaled(x)
        return ((_forward(_layers(self.arrays["weights"], tuple(self.arrays["dims"].astype(int))), z)[-1] - z) ** 2).mean(1)


class AutoEncoder(ArrayEstimator):
    """A 64-32-8-32-64 network with ReLU, trained by Adam on mini-batches.

    One Spark job per epoch: each task walks its rows in mini-batches, every step with the weights that the step before left, and
    returns the weights and Adam moments it ended with; their averages, weighted by rows, start the next epoch.  With one partition
    this is plain mini-batch training, and a partition of up to ``HELD`` numbers takes all epochs in one job, with the same result.
    Tasks add these up, per lane first, so the driver takes one weight-sized row a job.
    """

    epochs = _param("epochs", "passes over the rows", TypeConverters.toInt)
    batch = _param("batch", "rows of a step", TypeConverters.toInt)
    rate = _param("rate", "learning rate", TypeConverters.toFloat)

    def __init__(self, **params):
        super().__init__()
        self._setDefault(epochs=120, batch=32, rate=1e-3)
        self._set(**params)

    def _fit(self, df: DataFrame) -> AutoEncoderModel:
        rows, spark = self._numbers(df), df.sparkSession
        arrays = scaling(rows)
        size, rate, seed = self.getOrDefault(self.batch), self.getOrDefault(self.rate), self.getSeed()
        # in the order of a hash, so that a mini-batch is a random one and reruns agree
        train = materialise(rows.select(scale("x", arrays).alias("z")).orderBy(F.xxhash64("z", F.lit(seed))), "train")
        parts = train.rdd.getNumPartitions()
        dims = (len(arrays["mean"]), *HIDDEN, len(arrays["mean"]))
        rng = np.random.default_rng(seed)
        flat = np.concatenate([np.concatenate([rng.uniform(-1, 1, a * b), rng.uniform(-1, 1, b)]) / np.sqrt(a) for a, b in zip(dims, dims[1:], strict=False)])
        state, steps = np.stack([flat, np.zeros_like(flat), np.zeros_like(flat)]), 0

        def walk(blocks: Iterator[np.ndarray], state: np.ndarray, steps: int, epoch: int) -> tuple[np.ndarray, int, int]:
            """One epoch over the rows of a task: weights and moments times rows, rows, steps."""
            (weights, first, second), done, seen = state.copy(), steps, 0
            for data in blocks:
                data = data[np.random.default_rng([seed, epoch, seen]).permutation(len(data))]
                for at in range(0, len(data), size):
                    g = _gradient(_layers(weights, dims), data[at : at + size])
                    done += 1
                    first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
                    weights = weights - rate * (first / (1 - 0.9**done)) / (np.sqrt(second / (1 - 0.999**done)) + 1e-8)
                seen += len(data)
            return np.stack([weights, first, second]) * seen, seen, done - steps

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("part")  # sums do not depend on the order in which rows arrive
            return pd.DataFrame({"part": pdf["part"].iloc[:1], "n": [pdf["n"].sum()], "steps": [pdf["steps"].max()], "s": [sum(np.array(s) for s in pdf["s"]).tolist()]})

        def add_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [f for f in frames if len(f)]
            if held:
                yield add(pd.concat(held))

        schema, epochs = "part int, n long, steps long, s array<double>", self.getOrDefault(self.epochs)
        at_once = epochs if parts == 1 and train.count() * dims[0] <= HELD else 1
        for begun in range(0, epochs, at_once):
            start = spark.sparkContext.broadcast((state, steps))

            def run(frames: Iterator[pd.DataFrame], start=start, begun=begun) -> Iterator[pd.DataFrame]:
                (state, steps), n, taken = start.value, 0, 0
                blocks = (np.stack(f["z"].to_numpy()) for f in frames if len(f))
                blocks = blocks if at_once == 1 else list(blocks)
                for epoch in range(begun, begun + at_once):
                    if n:
                        state = total / n
                    total, n, more = walk(blocks, state, steps + taken, epoch)
                    taken += more
                if n:
                    yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "n": [n], "steps": [taken], "s": [total.ravel().tolist()]})

            ended = train.mapInPandas(run, schema)
            if parts > LANES:
                ended = ended.groupBy(F.pmod("part", F.lit(LANES))).applyInPandas(add, schema)
            if parts > 1:
                ended = ended.repartition(1).mapInPandas(add_all, schema)
            (ended,) = ended.collect()  # first() would leave the worker's stream half read, and each epoch would start a new worker
            state = np.array(ended["s"]).reshape(state.shape) / ended["n"]
            steps += ended["steps"]
            start.unpersist()
        return self._made(AutoEncoderModel(arrays | {"weights": state[0], "dims": np.array(dims, float)}))


# --- kernel features -------------------------------------------------------------------------

class KernelFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Vectors whose products approximate a kernel, so that a linear classifier on them is a kernel classifier.

    ``rbf``: random cosines of exp(-gamma |x - y|^2).  ``poly``: a tensor sketch of (gamma x.y + 1)^degree over all values of x: each factor is a
    count sketch, and the sketch of their product is the circular convolution of the factors', taken by FFT; where all monomials fit into
    ``width`` they are taken themselves.  ``width`` bounds the result; the random numbers follow from the seed, so a loaded transformer
    gives the same features.
    """

    kernel = _param("kernel", "rbf or poly", TypeConverters.toString)
    gamma = _param("gamma", "kernel scale, 0 for 1 / number of values", TypeConverters.toFloat)
    degree = _param("degree", "degree of poly", TypeConverters.toInt)
    width = _param("width", "number of features", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="expanded", kernel="rbf", gamma=0.0, degree=3, width=1024, seed=42):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="expanded", kernel="rbf", gamma=0.0, degree=3, width=1024, seed=42)
        self._set(**self._input_kwargs)

    def features(self, x: np.ndarray) -> np.ndarray:
        get = self.getOrDefault
        width, d = get(self.width), x.shape[1]
        gamma = get(self.gamma) or 1.0 / d
        rng = np.random.default_rng(self.getSeed())
        if get(self.kernel) == "rbf":
            w, b = rng.normal(0, np.sqrt(2 * gamma), (d, width)), rng.uniform(0, 2 * np.pi, width)
            return np.sqrt(2 / width) * np.cos(x @ w + b)
        x = np.concatenate([np.sqrt(gamma) * x, np.ones((len(x), 1))], axis=1)
        degree = get(self.degree)
        if comb(d + degree, degree) <= width:
            chosen = list(combinations_with_replacement(range(d + 1), degree))
            weight = [sqrt(factorial(degree) / prod(factorial(n) for n in Counter(c).values())) for c in chosen]
            return np.stack([w * x[:, list(c)].prod(1) for c, w in zip(chosen, weight, strict=True)], axis=1)
        product = np.ones((len(x), width // 2 + 1), complex)
        for _ in range(degree):
            slot, sign = rng.integers(0, width, d + 1), rng.choice([-1.0, 1.0], d + 1)
            sketch = np.zeros((d + 1, width))
            sketch[np.arange(d + 1), slot] = sign
            product *= np.fft.rfft(x @ sketch, axis=1)
        return np.fft.irfft(product, n=width, axis=1)

    def _transform(self, df: DataFrame) -> DataFrame:
        name = self.getInputCol()
        x = vector_to_array(F.col(name)) if isinstance(df.schema[name].dataType, VectorUDT) else F.col(name).cast(ArrayType(DoubleType()))
        kernel = self.copy()

        @F.pandas_udf(ArrayType(DoubleType()))
        def run(s: pd.Series) -> pd.Series:
            return pd.Series(list(kernel.features(np.stack(s.to_numpy()))) if len(s) else [], dtype=object)

        return df.withColumn(self.getOutputCol(), array_to_vector(run(x)))
