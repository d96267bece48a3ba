"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Each whole text becomes STATISTICS numbers in one pass. They are standardised, mapped by random cosines that approximate
a Gaussian kernel, and fitted to the labels by ridge: tasks add up normal equations, Spark adds the tasks' sums, the
driver solves one system of FEATURES + 1 unknowns. Scores are calibrated by pooling adjacent violators over counts in BINS
score bins. All labelled rows that ``learn`` selects are used; no other label is read.

Null and empty texts have statistics of their own (zeros) and are scored like any other text. Without labels all scores
are 0. Null labels are skipped; of several labels of a document the largest counts; repeated rows score alike; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import over_texts, stage

STATISTICS = (
    "log_words log_chars log_lines mean_word mean_line letters upper digits spaces non_ascii stops commas marks_twice symbols pipes "
    "distinct_words distinct_lines longest_word common_word short_lines ends_well"
).split()
FEATURES = 256
#: Sums that reach the driver.
GROUPS = 8
BINS = 1024
_LETTERS = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
_SYMBOLS = np.array([b < 128 and not chr(b).isalnum() and not chr(b).isspace() and chr(b) not in ".,;:?!'\"()-" for b in range(256)])


def statistics(text: bytes) -> list[float]:
    """Shares of byte classes and figures on words and lines of a whole text."""
    if not text:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = len(text)
    words, lines = text.split(), text.split(b"\n")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    uses: dict[bytes, int] = {}
    for w in words:
        uses[w] = uses.get(w, 0) + 1
    n_words, n_lines = max(1, len(words)), len(lines)
    doubled = text.count(b"!!") + text.count(b"##") + text.count(b"$$") + text.count(b"%%") + text.count(b"&&") + text.count(b"**")
    return [
        np.log1p(len(words)), np.log1p(n), np.log1p(n_lines), sizes.sum() / n_words, np.log1p(n / n_lines),
        count[_LETTERS].sum() / n, count[65:91].sum() / n, count[48:58].sum() / n, (count[32] + count[10]) / n, count[128:].sum() / n,
        count[46] / n_words, count[44] / n_words, doubled / n_words, count[_SYMBOLS].sum() / n, count[124] / n_words,
        len(uses) / n_words, len(set(lines)) / n_lines, np.log1p(sizes.max(initial=0)), max(uses.values(), default=0) / n_words,
        sum(len(x) < 20 for x in lines) / n_lines, sum(x.rstrip()[-1:] in b".!?" for x in lines) / n_lines,
    ]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics."""

    def work(part: pa.RecordBatch):
        return {"doc_id": part.column("doc_id"), "stats": [statistics(t or b"") for t in part.column("text").cast(pa.binary()).to_pylist()]}

    return over_texts(docs.select("doc_id", "text"), work, "doc_id long, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    turn: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    edges: tuple[float, float] = (0.0, 1.0)
    calibrated: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.cos((stats - self.mean) / self.spread @ self.turn + self.phase) * np.sqrt(2 / self.turn.shape[1])
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def bins(self, raw: np.ndarray) -> np.ndarray:
        low, high = self.edges
        return np.clip(((raw - low) / (high - low) * BINS).astype(np.int64), 0, BINS - 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(stats))
        return self.calibrated[self.bins(self.raw(stats))]


def isotonic(ones: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Non-decreasing shares closest to ``ones / all_`` in weighted squares; empty bins take the share of the bin before."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(all_ > 0):
        blocks.append([ones[i], all_[i], i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2]]
    out = np.zeros(len(all_))
    for s, n, start in blocks:
        out[int(start) :] = s / n
    if blocks:
        out[: int(blocks[0][2])] = blocks[0][0] / blocks[0][1]
    return out


def _stack(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("stats").to_pylist(), float).reshape(batch.num_rows, -1)


def _add_up(rows: DataFrame, per_batch, width: int) -> np.ndarray:
    """Sum of one vector per task: tasks are summed in groups, those in GROUPS more, so the driver gets GROUPS vectors however many tasks there are."""

    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += per_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

    def merge(batches):
        total = np.zeros(width)
        for batch in batches:
            for x in batch.column("sum").to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

    parts = rows.mapInArrow(run, "sum binary")
    groups = max(GROUPS, rows.sparkSession.sparkContext.defaultParallelism)
    merged = parts.repartition(groups).mapInArrow(merge, "sum binary").repartition(GROUPS).mapInArrow(merge, "sum binary")
    return sum((np.frombuffer(bytes(r["sum"])) for r in merged.collect()), np.zeros(width))


def fit(stats: DataFrame, labels: DataFrame, learn: Column, ridge: float = 1e-3, width: float = 3.0, seed: int = 11) -> Model:
    """``stats`` as from ``measure``; ``labels`` has doc_id and ``y``; rows where ``learn`` holds are learnt from, all of them."""
    known = labels.where(learn & F.col("y").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").cast("double").alias("y"))
    rows = stage(stats.join(known, "doc_id").select("stats", "y"), "labelled")
    d = len(STATISTICS)

    def moments(batch):
        x = _stack(batch)
        return np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)])

    m = _add_up(rows, moments, 1 + 2 * d)
    n = max(1.0, m[0])
    mean = m[1 : 1 + d] / n
    spread = np.sqrt(np.maximum(m[1 + d :] / n - mean**2, 1e-12))
    rng = np.random.default_rng(seed)
    model = Model(mean, np.where(spread < 1e-5, 1.0, spread), rng.normal(0, 1 / width, (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES))
    if not m[0]:
        return model
    size = FEATURES + 1

    def normal(batch):
        z, y = model.features(_stack(batch)), batch.column("y").to_numpy()
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [y.sum()]])

    total = _add_up(rows, normal, size * size + size + 1)
    gram, right = total[: size * size].reshape(size, size), total[size * size : -1]
    penalty = np.diag([ridge * n] * FEATURES + [0.0])
    weights = np.linalg.solve(gram + penalty, right)
    model.weights = weights

    def span(batch):
        raw = model.raw(_stack(batch))
        hit = model.bins(raw)
        return np.concatenate([np.bincount(hit, batch.column("y").to_numpy(), BINS), np.bincount(hit, minlength=BINS)])

    model.edges = (-0.5, 1.5)
    counts = _add_up(rows, span, 2 * BINS)
    model.calibrated = isotonic(counts[:BINS], counts[BINS:])
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and calibrated score of every row of ``measure``."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(_stack(batch)))], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")
