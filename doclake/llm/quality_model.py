"""Quality classifier by positive-unlabelled learning.

Trusted positives are texts labelled good; everything else is a mixture of good and bad text whose share of good is the class
prior, estimated from the labelled training rows. A linear model over binned style features minimises the non-negative unbiased
risk on a bounded sample, its scores are calibrated on labelled training rows, and all texts are then scored row by row, without
a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import with_fields

#: Documents of each kind (labelled, unlabelled) that training takes at most.
SAMPLE = 10_000
#: Bins of each feature, steps of gradient descent, step size, and weight decay.
BINS, STEPS, RATE, DECAY = 12, 400, 0.05, 1e-4
#: Share of good text where no labels tell it.
DEFAULT_PRIOR = 0.8
#: Labels of documents with this remainder are never learnt from.
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

FEATURES = [
    "words", "word_length", "distinct_words", "repeated_pairs", "top_word", "upper", "digits", "marks", "bars", "exclamations",
    "sentence_ends", "commas", "spaces", "lines", "distinct_lines", "ended_lines", "short_lines", "high_bytes",
]


def features(text: str) -> list[float]:
    """Style of a whole text, independent of its language."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    share = lambda characters: float(sum(seen[ord(c)] for c in characters)) / n
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 0
    most = max(counts.values())
    lines = [x for x in text.split("\n") if x]
    ended = sum(x.rstrip()[-1:] in ".!?\"'»)" for x in lines)
    short = sum(len(x) < 40 for x in lines)
    return [
        float(np.log1p(n)), len(text) / n, len(counts) / n, 1 - pairs / max(1, n - 1), most / n,
        float(seen[65:91].sum()) / size, float(seen[48:58].sum()) / size, share("#*$%&<>{}[]\\^~=_"), share("|"), share("!"),
        share(".?"), share(",;:"), float(seen[32]) / size, len(lines) / n, len(set(lines)) / max(1, len(lines)),
        ended / max(1, len(lines)), short / max(1, len(lines)), float(seen[128:].sum()) / size,
    ]


@dataclass(frozen=True)
class Model:
    edges: np.ndarray  # (features, BINS - 1)
    weights: np.ndarray  # (features * BINS,)
    bias: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Column of the weight for each feature of each row."""
        found = np.stack([np.searchsorted(self.edges[k], x[:, k], side="right") for k in range(x.shape[1])], axis=1)
        return found + np.arange(x.shape[1]) * (self.edges.shape[1] + 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.weights[self.binned(x)].sum(axis=1) + self.bias)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimise prior * E+[l(g)] + max(0, Eu[l(-g)] - prior * E+[l(-g)]) with the logistic loss."""
    k = len(FEATURES)
    both = np.concatenate([positive, unlabelled]) if len(positive) + len(unlabelled) else np.zeros((1, k))
    quantiles = np.quantile(both, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    # rare junk sits in the tails: half of the cuts are quantiles, half are spread over the range
    spread = np.linspace(both.min(axis=0), both.max(axis=0), BINS + 1)[1:-1].T
    edges = np.sort(np.where(np.arange(BINS - 1) % 2 == 0, quantiles, spread), axis=1)
    model = Model(edges, np.zeros(k * BINS), 0.0)
    if not len(positive) or not len(unlabelled):
        return Model(edges, np.zeros(k * BINS), float(np.log(prior / (1 - prior))))
    one_hot = lambda x: _one_hot(model.binned(x), k * BINS)
    p, u = one_hot(positive), one_hot(unlabelled)
    w, b = np.zeros(k * BINS), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(k * BINS + 1), np.zeros(k * BINS + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, STEPS + 1):
        gp, gu = sigmoid(p @ w + b), sigmoid(u @ w + b)
        loss_u, loss_p = np.logaddexp(0, u @ w + b).mean(), np.logaddexp(0, p @ w + b).mean()
        dp_bad, du = gp / len(gp), gu / len(gu)  # derivatives of E[l(-g)]
        dp_good = (gp - 1) / len(gp)
        if loss_u - prior * loss_p >= 0:
            dp, du = prior * dp_good - prior * dp_bad, du
        else:  # the negative part is over-fitted: step back on it
            dp, du = prior * dp_bad, -du
        grad = np.append(p.T @ dp + u.T @ du + DECAY * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return Model(edges, w, b)


def calibrated(model: Model, x: np.ndarray, quality: np.ndarray) -> Model:
    """The same ranking with scores that are probabilities of label 1: Platt's scaling on labelled training rows.

    Left as it is where these hold one kind of label only.
    """
    good, bad = int((quality == 1).sum()), int((quality == 0).sum())
    if not good or not bad:
        return model
    g = model.weights[model.binned(x)].sum(axis=1) + model.bias
    target = np.where(quality == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * g + b, -30, 30)))
        d, s = p - target, p * (1 - p) + 1e-9
        h = np.array([[(s * g * g).sum() + 1e-6, (s * g).sum()], [(s * g).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, [(d * g).sum(), d.sum()])
        step *= min(1.0, 5 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return Model(model.edges, model.weights * max(a, 1e-3), float(model.bias * max(a, 1e-3) + b))


def _one_hot(columns: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(columns), width), np.float32)
    out[np.arange(len(columns))[:, None], columns] = 1
    return out


def held_out(doc_id: Column) -> Column:
    """Whether labels of this document are kept for testing; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def _sample(rows: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` rows of a hash order of their ids, the same ones every time."""
    return rows.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(bound)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on documents whose labels may be learnt from.

    Labelled rows and rows without a label are drawn in a hash order of their ids, at most ``sample`` of each, by id before any
    text is read. Rows without an id are never drawn; conflicting labels of one id count as bad.
    """
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    drawn = _sample(usable.groupBy("doc_id").agg(F.min("quality").alias("quality")), sample)
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    free = _sample(ids.join(labels.select("doc_id"), "doc_id", "left_anti"), sample).withColumn("quality", F.lit(None).cast("int"))
    chosen = drawn.select("doc_id", F.col("quality").cast("int").alias("quality")).unionByName(free)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * sample ids
    # of the texts of a repeated id the smallest, and rows in the order of their ids: the same model every time
    one = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = sorted(_featured(one, ["doc_id", "quality"]).collect(), key=lambda r: r["doc_id"])
    labelled = np.array([r["quality"] if r["quality"] is not None else -1 for r in got])
    x = np.array([r["f"] for r in got], np.float64).reshape(len(got), len(FEATURES))
    known = labelled[labelled >= 0]
    prior = float(np.clip(known.mean(), 0.05, 0.95)) if len(known) else DEFAULT_PRIOR
    free_rows = labelled == -1
    model = fit(x[labelled == 1], x[free_rows] if free_rows.any() else x, prior)
    return calibrated(model, x[labelled >= 0], known)


def _featured(rows: DataFrame, kept: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t.as_py() or "") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(f, pa.list_(pa.float64()))], names=[*kept, "f"])

    return rows.select(*kept, "text").mapInArrow(run, with_fields(rows.select(*kept), "f array<double>"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1; 0 for null and wordless texts). An own column of that name is replaced."""
    kept = [c for c in docs.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py() or "") for t in b.column("text")], np.float64).reshape(b.num_rows, len(FEATURES))
            s = np.where(x[:, 0] > 0, model.score(x), 0.0)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(s, pa.float64())], names=[*kept, "score"])

    return docs.select(*kept).mapInArrow(run, with_fields(docs.select(*kept), "score double"))


def report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    own = docs.select("doc_id", "text")
    scored = score(own, train(own, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows of ``docs`` that the classifier accepts, with the same columns."""
    model = train(docs.select("doc_id", "text"), labels, sample)
    out = score(docs.withColumnRenamed("score", "__score"), model).filter(F.col("score") >= THRESHOLD).drop("score")
    return out.withColumnRenamed("__score", "score").select(*docs.columns)
