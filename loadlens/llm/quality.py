"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Features are indicators of a text's byte n-grams of one to four bytes, hashed into
``BINS`` bins, and of its word n-grams that repeat one word two, three or four times
(invented or rare words are never seen again, repetition is). Every indicator is
scaled by the log-count ratio of its bin: how much more often it occurs in texts of
label 1 than of label 0, counted over all training rows in Spark. A linear
hinge-loss model on the scaled indicators, brought to length one, is fitted by dual
coordinate descent on at most ``SAMPLE_PER_CLASS`` rows of each class, those with
the smallest hashes; a quarter of them is kept out and turns margins into
probabilities, weighted to the classes' shares among all training rows.

Texts are used whole. Null and empty texts have no features and get the score of the
bias. Labels other than 0 and 1, or without id, are ignored; of several labels of a
document the largest counts. Repeated documents count each time. Without rows of both
classes every score is the share of label 1, smoothed by one row each. Only the text
is an input of a score. Extra columns of either table are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loadlens.operators.joins import lookup_join

BINS = 1 << 18
ORDERS = (1, 2, 3, 4)
REPEATS = (2, 3, 4)
SAMPLE_PER_CLASS = 4096
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 20
THRESHOLD = 0.3
SEED = 7
STRETCH = 1 << 16
# Fixed odd multipliers: a byte's place in the n-gram, and the spread over the bins.
_PLACES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


class Features:
    """Bins of a text's n-grams; one instance per task, as it keeps a table of marks."""

    def __init__(self):
        self.marks = np.zeros(BINS, dtype=bool)

    def of(self, text: str | None) -> np.ndarray:
        """Sorted bins whose indicator is set."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        marks = self.marks
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        longest = max(ORDERS)
        # Stretches overlap by the longest n-gram, so none is lost between them.
        for at in range(0, len(raw), STRETCH):
            some = raw[at:at + STRETCH + longest - 1].astype(np.uint32)
            total = np.zeros(len(some), dtype=np.uint32)
            for n in range(1, longest + 1):
                if len(some) < n:
                    break
                total = total[:len(some) - n + 1] + (some[n - 1:] + np.uint32(1)) * _PLACES[n - 1]
                if n in ORDERS:
                    mixed = (total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
                    marks[mixed >> np.uint32(14)] = True
        words = text.split()
        for n in REPEATS:
            if len(words) >= n and _repeats(words, n):
                marks[n] = True
        found = np.flatnonzero(marks).astype(np.int32)
        marks[found] = False
        return found


def _repeats(words: list[str], n: int) -> bool:
    same = map(str.__eq__, words, words[1:])
    run = 1
    for equal in same:
        run = run + 1 if equal else 1
        if run == n:
            return True
    return False


def held_out(ident: str | Column = "doc_id", folds: int = 5) -> Column:
    """Whether a row may never be learned from: crc32 of its id as text, modulo the folds."""
    ident = F.col(ident) if isinstance(ident, str) else ident
    return F.coalesce(F.crc32(ident.cast("string")) % folds == 0, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label): one usable label per document that is not held out."""
    usable = F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()
    return labels.where(usable).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))


def class_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each class, and for each bin how many rows of each class have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        counts = np.zeros((2, BINS), dtype=np.int64)
        rows = np.zeros(2, dtype=np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[label, features.of(text)] += 1
                rows[label] += 1
        some = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(some, BINS)), pa.array(np.append(counts[0, some], rows[0])),
                pa.array(np.append(counts[1, some], rows[1])),
            ],
            names=["bin", "zero", "one"],
        )

    # At most BINS + 1 rows reach the driver.
    totals = (
        texts.select("text", "label").mapInArrow(run, "bin BIGINT, zero BIGINT, one BIGINT")
        .groupBy("bin").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).toArrow()
    )
    counts = np.zeros((2, BINS + 1), dtype=np.int64)
    at = totals.column("bin").to_numpy()
    counts[0, at] = totals.column("zero").to_numpy()
    counts[1, at] = totals.column("one").to_numpy()
    return counts[:, BINS].copy(), counts[:, :BINS]


def log_count_ratios(counts: np.ndarray) -> np.ndarray:
    smooth = counts + SMOOTHING
    shares = smooth / smooth.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(
    rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, costs: np.ndarray,
    size: int, epochs: int = EPOCHS, seed: int = SEED, tolerance: float = 1e-3,
) -> np.ndarray:
    """Weights of min |w|^2 / 2 + sum cost * max(0, 1 - sign * w.x), x sparse.

    One dual variable at a time is moved to its best value in [0, cost].
    """
    weights = np.zeros(size)
    alphas = np.zeros(len(rows))
    squares = np.array([float(v @ v) for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            if squares[i] == 0:
                continue
            slope = signs[i] * float(weights[rows[i]] @ values[i]) - 1
            moved = min(max(alphas[i] - slope / squares[i], 0.0), costs[i])
            step = moved - alphas[i]
            if step:
                weights[rows[i]] += signs[i] * step * values[i]
                alphas[i] = moved
                worst = max(worst, abs(step) * squares[i])
        if worst < tolerance:
            break
    return weights


def _sigmoid(margins: np.ndarray, signs: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the margins, by Newton steps."""
    ones, zeros = weights[signs > 0].sum(), weights[signs < 0].sum()
    targets = np.where(signs > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    slope, offset = 1.0, float(np.log((ones + 1) / (zeros + 1)))
    x = np.column_stack([margins, np.ones(len(margins))])

    def loss(s, o):
        z = s * margins + o
        return float((weights * (np.logaddexp(0, z) - targets * z)).sum()) + 1e-3 * s * s

    now = loss(slope, offset)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -35, 35)))
        gradient = x.T @ (weights * (p - targets)) + np.array([2e-3 * slope, 0.0])
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + np.diag([2e-3, 1e-9])
        move = np.linalg.solve(hessian, gradient)
        rate = 1.0
        while rate > 1e-6:
            new = loss(slope - rate * move[0], offset - rate * move[1])
            if new <= now:
                break
            rate /= 2
        slope, offset = slope - rate * move[0], offset - rate * move[1]
        if now - new < 1e-9:
            break
        now = new
    return max(float(slope), 0.0), float(offset)


@dataclass(frozen=True)
class Model:
    """Scores a set of bins; ``ratios`` and ``weights`` have one more value, the bias's."""

    ratios: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def margin(self, bins: np.ndarray) -> float:
        own, length = scaled(bins, self.ratios)
        return float(self.weights[own] @ length)

    def score(self, bins: np.ndarray) -> float:
        z = min(max(self.slope * self.margin(bins) + self.offset, -35.0), 35.0)
        return float(1 / (1 + np.exp(-z)))


def scaled(bins: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled indicators of length one, and the bias, which is the last feature."""
    values = ratios[bins]
    length = float(np.sqrt(values @ values))
    if length:
        values = values / length
    return np.append(bins, len(ratios)), np.append(values, 1.0)


def fit_sample(rows: list[np.ndarray], labels: np.ndarray, kept_out: np.ndarray,
               ratios: np.ndarray, class_rows: np.ndarray) -> Model:
    """Fit on the rows not kept out, fit the probabilities on the others."""
    pairs = [scaled(r, ratios) for r in rows]
    signs = np.where(labels == 1, 1.0, -1.0)
    if len(set(signs[~kept_out])) < 2 or len(set(signs[kept_out])) < 2:
        kept_out = np.zeros(len(rows), dtype=bool)
        trained = calibrated = np.arange(len(rows))
    else:
        trained, calibrated = np.flatnonzero(~kept_out), np.flatnonzero(kept_out)
    each = {s: max(1, int((signs[trained] == s).sum())) for s in (1.0, -1.0)}
    costs = np.array([COST * len(trained) / (2 * each[s]) for s in signs[trained]])
    weights = dual_coordinate_descent(
        [pairs[i][0] for i in trained], [pairs[i][1] for i in trained], signs[trained], costs,
        len(ratios) + 1,
    )
    margins = np.array([float(weights[pairs[i][0]] @ pairs[i][1]) for i in calibrated])
    own = signs[calibrated]
    share = {1.0: class_rows[1], -1.0: class_rows[0]}
    importance = np.array([share[s] / max(1, int((own == s).sum())) for s in own], dtype=float)
    importance *= len(own) / importance.sum()
    slope, offset = _sigmoid(margins, own, importance)
    return Model(ratios, weights, slope, offset)


def fit(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Counts over all training rows, then the model of a bounded sample of them."""
    usable = training_labels(labels)
    texts = docs.select("doc_id", "text")
    class_rows, counts = class_counts(
        lookup_join(texts, usable, "doc_id", spread_by="row").select("text", "label")
    )
    if not class_rows.all():
        share = (class_rows[1] + 1) / (class_rows.sum() + 2)
        nothing = np.zeros(BINS)
        return Model(nothing, np.zeros(BINS + 1), 0.0, float(np.log(share / (1 - share))))
    ratios = log_count_ratios(counts)
    order = F.xxhash64("doc_id")
    chosen = usable.where("label = 0").orderBy(order, "doc_id").limit(sample_per_class).unionByName(
        usable.where("label = 1").orderBy(order, "doc_id").limit(sample_per_class)
    )
    # Bounded by the two limits, so one task and a broadcast hold it.
    sample = texts.join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "text", "label", (F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(4)) == 0).alias("out")
    )

    def bins_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            bins = [features.of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bins, pa.list_(pa.int32())), batch.column(2),
                 batch.column(3)],
                names=["doc_id", "bins", "label", "out"],
            )

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            bins = batch.column("bins")
            for n, (ident, label, out) in enumerate(zip(*(
                batch.column(c).to_pylist() for c in ("doc_id", "label", "out")
            ))):
                found.append((ident, label, out, bins[n].values.to_numpy()))
        if not found:
            return
        # Repeated ids may exceed the limits; the order makes reruns agree.
        found.sort(key=lambda r: (r[0], len(r[3]), r[3].tobytes()))
        model = fit_sample(
            [r[3] for r in found], np.array([r[1] for r in found]),
            np.array([r[2] for r in found], dtype=bool), ratios, class_rows,
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights.tobytes()]), pa.array([model.slope]), pa.array([model.offset])],
            names=["weights", "slope", "offset"],
        )

    row = (
        sample.mapInArrow(bins_of, "doc_id BIGINT, bins ARRAY<INT>, label INT, out BOOLEAN")
        .repartition(1).mapInArrow(fit_all, "weights BINARY, slope DOUBLE, offset DOUBLE").first()
    )
    return Model(ratios, np.frombuffer(bytes(row["weights"])), row["slope"], row["offset"])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` with the score of their text."""
    spark = docs.sparkSession
    # The model has a fixed size, whatever the input.
    sent = spark.sparkContext.broadcast(
        (model.ratios.astype(np.float32), model.weights.astype(np.float32), model.slope, model.offset)
    )
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        features = Features()
        for batch in batches:
            scores = [own.score(features.of(t)) for t in batch.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name]
            )

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
