"""Quality classifier by positive-unlabelled learning.

Trusted positives are the documents labelled 1 in the training folds; unlabelled are all documents of those folds. No
other label is used. With class prior p a linear model minimises the non-negative unbiased risk

    p E_pos[loss(+)] + max(0, E_unl[loss(-)] - p E_pos[loss(-)])

with the logistic loss. loss(+) - loss(-) is linear there, so where the second term is not negative the risk is convex and
Newton's method applies. Of several lengths of a step the one of lowest risk is taken among those that leave the second
term at 0 or more; if there is none, which is where such a model overfits, the step goes back along that term's gradient.

The prior is estimated from the scores of a model that tells half of the positives from half of the unlabelled: on the
other halves, the share of unlabelled above a threshold, over that of positives, is least where only positives are left
(best bin estimation). Each round is two Spark jobs over a written table of features: tasks sum risks, gradients and
Hessians, Spark adds them up by position, and the driver receives one number per position, as many for any input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import bounded_batches, materialize, table

SYMBOLS = np.frombuffer(b"#$%&*@^~<>{}[]=_\\/+", np.uint8)
HINGED = slice(3, 20)
ROUNDS, ENOUGH = 12, 1e-4
#: The ridge: a part for any size, and one that is divided by the number of positives.
RIDGE, RIDGE_OF_FEW = 1e-4, 0.1
#: Lengths of a Newton step that are tried together, how far a step back goes, and the bins of scores for the prior.
LENGTHS, BACK, BINS = 0.5 ** np.arange(0, 16, 1.5), 0.1, 1000
N_BASE = 20
N_FEATURES = N_BASE + (HINGED.stop - HINGED.start)


def features(text: bytes) -> np.ndarray:
    """Shape, symbols, repetition and word statistics of a whole text, each between 0 and 1, then the same magnified."""
    x = np.zeros(N_BASE, np.float64)
    x[0] = 1
    words = text.split()
    if not words:
        x[1] = 1
    else:
        low, n, size = text.lower().split(), len(words), len(text)
        at = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        upper, lower = at[65:91].sum(), at[97:123].sum()
        lines = text.split(b"\n")
        counts: dict[bytes, int] = {}
        for w in low:
            counts[w] = counts.get(w, 0) + 1
        lengths = np.fromiter(map(len, words), np.int64, n)
        x[2:] = (
            np.log1p(size) / 16,
            upper / max(1, upper + lower),
            at[48:58].sum() / size,
            at[SYMBOLS].sum() / size,
            at[124] / n,
            at[33] / n,
            (at[46] + at[44]) / n,
            at[128:].sum() / size,
            lengths.mean() / 20,
            (lengths <= 3).mean(),
            1 - len(counts) / n,
            max(counts.values()) / n,
            sum(a == b for a, b in zip(low, low[1:])) / n,
            1 - len(set(zip(low, low[1:], low[2:]))) / max(1, n - 2) if n > 2 else 0,
            sum(map(bytes.isupper, words)) / n,
            1 - len(set(lines)) / len(lines),
            at[SYMBOLS].sum() / n,
            len(lines) / n,
        )
    x = np.clip(x, 0, 1)
    return np.concatenate((x, np.minimum(1, 10 * x[HINGED])))


def feature_column(text: Column) -> Column:
    """The features of each text, null as empty; only texts go to Python."""

    def of(texts: pa.Array) -> pa.Array:
        own = [features(t.as_py() or b"").astype(np.float32) for t in texts.cast(pa.binary())]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * N_FEATURES, pa.int32()), pa.array(np.concatenate(own) if own else []).cast(pa.float32()))

    return F.arrow_udf(of, "array<float>")(text)


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(np.float64)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _added(rows: DataFrame, size: int, of) -> np.ndarray:
    """The sum over rows (x, trusted) of the `size` numbers that of(matrix, trusted) gives for a batch."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += of(_matrix(batch.column("x")), np.asarray(batch.column("trusted").to_pylist(), bool))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["at", "value"])

    found = rows.select("x", "trusted").mapInArrow(add, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    return found.sort_values("at")["value"].to_numpy() if len(found) else np.zeros(size)


class Risk:
    """a E_pos[loss(+)] + max(0, E_unl[loss(-)] - b E_pos[loss(-)]) over rows (x, trusted), for linear models.

    a = b = prior is the risk of the method; a = 1, b = 0 tells positives from unlabelled, whatever the prior.
    """

    def __init__(self, rows: DataFrame, a: float, b: float):
        self.rows, self.a, self.b = rows, a, b
        self.n, self.n_pos = _added(rows, 2, lambda x, t: np.array([len(x), t.sum()], float))
        self.ridge = RIDGE + RIDGE_OF_FEW / max(1, self.n_pos)

    def at(self, trials: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each trial, a row of weights: the risk with its ridge, and its second term before it is cut off at 0."""

        def losses(x: np.ndarray, t: np.ndarray) -> np.ndarray:
            z = x @ trials.T
            return np.concatenate((_softplus(z).sum(axis=0), _softplus(-z[t]).sum(axis=0), _softplus(z[t]).sum(axis=0)))

        unl, plus, minus = _added(self.rows, 3 * len(trials), losses).reshape(3, -1)
        negative = unl / self.n - self.b * minus / self.n_pos
        return self.a * plus / self.n_pos + np.maximum(0, negative) + self.ridge * (trials[:, 1:] ** 2).sum(axis=1) / 2, negative

    def derivatives(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradient and Hessian of the risk where the second term is not negative, and that term's gradient."""
        d = N_FEATURES

        def sums(x: np.ndarray, t: np.ndarray) -> np.ndarray:
            s = 1 / (1 + np.exp(-(x @ w)))
            y, q = x[t], s[t]
            square = lambda x, s: ((x * (s * (1 - s))[:, None]).T @ x).ravel()
            return np.concatenate((s @ x, q @ y, y.sum(axis=0), square(x, s), square(y, q)))

        total = _added(self.rows, 3 * d + 2 * d * d, sums)
        unl, pos, ones = total[: 3 * d].reshape(3, d)
        h_unl, h_pos = total[3 * d :].reshape(2, d, d)
        term = unl / self.n - self.b * pos / self.n_pos
        keep = self.ridge * np.append(0, np.ones(d - 1))
        gradient = term + self.a * (pos - ones) / self.n_pos + keep * w
        return gradient, h_unl / self.n + (self.a - self.b) * h_pos / self.n_pos + np.diag(keep + 1e-9), term

    def minimise(self, w: np.ndarray) -> np.ndarray:
        """Weights of least risk from w on; w itself if nothing is trusted."""
        if not self.n_pos:
            return w
        (risk,), _ = self.at(w[None])
        for _ in range(ROUNDS):
            gradient, hessian, term = self.derivatives(w)
            trials = w - np.outer(LENGTHS, np.linalg.solve(hessian, gradient))
            risks, negative = self.at(trials)
            fine = np.flatnonzero((negative >= 0) & (risks < risk))
            if len(fine):
                best = fine[risks[fine].argmin()]
                w, before, risk = trials[best], risk, risks[best]
                if before - risk < ENOUGH * before:
                    break
            else:
                back = w + BACK * term / max(1e-12, np.abs(term).max())
                (now,), (left,) = self.at(back[None])
                if left < 0 or now >= 2 * risk:
                    break
                w, risk = back, now
        return w


def class_prior(rows: DataFrame) -> float:
    """The share of positives among the unlabelled of rows (x, trusted, half), by best bin estimation."""
    w = Risk(rows.where("half = 0"), 1.0, 0.0).minimise(np.zeros(N_FEATURES))

    def bins(x: np.ndarray, t: np.ndarray) -> np.ndarray:
        at = np.minimum(BINS - 1, (BINS / (1 + np.exp(-(x @ w)))).astype(int))
        return np.concatenate((np.bincount(at, minlength=BINS), np.bincount(at[t], minlength=BINS)))

    unl, pos = _added(rows.where("half = 1"), 2 * BINS, bins).reshape(2, -1)[:, ::-1].cumsum(axis=1)
    if not pos[-1]:
        return 0.5
    seen = pos > 0
    share, of_pos = unl[seen] / unl[-1], pos[seen] / pos[-1]
    slack = sum(np.sqrt(np.log(4 / 0.1) / (2 * n)) for n in (unl[-1], pos[-1]))
    best = ((share + slack) / of_pos).argmin()
    return float(np.clip(share[best] / of_pos[best], 0.02, 0.98))


class QualityModel:
    """Weights learnt from the features and labels of a corpus; constant if there was no trusted positive."""

    def __init__(self, weights: np.ndarray, prior: float):
        self.weights, self.prior = weights, prior

    @property
    def constant(self) -> bool:
        return not self.weights[1:].any()

    @classmethod
    def train(cls, x: DataFrame, labels: DataFrame) -> "QualityModel":
        """x (doc_id, x), written; labels (doc_id, quality), of which only the 1s outside the held-out fold are read."""
        trusted = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
        half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half")
        rows = x.where(~held_out(F.col("doc_id"))).join(trusted, "doc_id", "left").select("x", F.col("quality").isNotNull().alias("trusted"), half)
        rows = materialize(rows, "quality-rows")
        prior = class_prior(rows)
        start = np.append(np.log(prior / (1 - prior)), np.zeros(N_FEATURES - 1))
        return cls(Risk(rows, prior, prior).minimise(start), prior)

    def score(self, x: Column) -> Column:
        """The scores of feature columns."""

        def of(column: pa.Array) -> pa.Array:
            return pa.array(np.round(1 / (1 + np.exp(-(_matrix(column) @ self.weights))), 9), pa.float64())

        return F.arrow_udf(of, "double")(x)


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null, empty and blank texts share one feature vector and so one score. A null doc_id is not held out and has no label.
    Rows that repeat in labels count once, as 0 if they disagree. Without trusted positives every score is 0.5. An empty
    table gives no rows. Only id and text of docs are read.
    """
    bounded_batches(docs.sparkSession)
    x = materialize(docs.select(F.col(doc_id).cast("long").alias("doc_id"), feature_column(F.col(text)).alias("x")), "quality-features")
    score = QualityModel.train(x, labels).score(F.col("x")).alias("score")
    return x.select("doc_id", score).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that the classifier doesn't reject; all of them if it had nothing to learn from.

    Null, empty and blank texts share one score, repeated rows share theirs; null doc_ids have no label. An empty table gives
    no rows. Extra columns may have any names. Features are computed once, in a table beside the rows, for training and for
    the scores alike.
    """
    bounded_batches(docs.sparkSession)
    wide = materialize(docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("own"), feature_column(F.col(text)).alias("x")), "quality-documents", "zstd")
    model = QualityModel.train(wide.select(F.col(f"own.{doc_id}").cast("long").alias("doc_id"), "x"), labels)
    return (wide if model.constant else wide.where(model.score(F.col("x")) >= 0.5)).select("own.*")


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
