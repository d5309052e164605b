"""Quality classifier: ordinal cumulative-link regression on hashed text.

A text has one score, the sum of the weights of its hashed features, whatever the grade; ordered thresholds
cut the score into grades: P(grade >= j) = sigmoid(score - threshold_j). The expected grade is the sum of
these tail probabilities, and the last one selects.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vectide.llm.shared import first_by_hash, text_key

BUCKETS = 1 << 18
# Labelled rows the model is fitted on, picked by hash of the id; a bound, whatever the number of labels.
SAMPLE = 20_000
# Share of the clean held-out documents that the selection must keep.
KEEP = 0.995
SEED = 7
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def features(text: bytes) -> np.ndarray:
    """Buckets of a text, each once: its words in lower case without outer marks, the words' first five
    bytes, and graded proportions."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    found = {w.lower().strip(_MARKS) for w in words}
    shares = (len(found) / max(1, n), (size - len(text.translate(None, _UPPER))) / size,
              (size - len(text.translate(None, _DIGITS))) / size, (size - len(text.translate(None, _MARKS))) / size,
              sum(a == b for a, b in zip(words, words[1:])) / max(1, n), min(1.0, size / max(1, n) / 20))
    graded = [b"\x00%d:%d" % (i, round(20 * share ** 0.5)) for i, share in enumerate(shares)]
    graded += [b"\x01" + stem for stem in {w[:5] for w in found}]
    digest = xxhash.xxh32_intdigest
    return np.unique(np.array([digest(w) % BUCKETS for part in (found, graded) for w in part], np.int32))


@dataclass
class Model:
    """weights by bucket; thresholds in ascending order, one less than grades; cut for the last tail probability."""

    weights: np.ndarray
    thresholds: np.ndarray
    cut: float

    def tails(self, buckets: list[np.ndarray]) -> np.ndarray:
        scores = np.array([self.weights[b].sum() for b in buckets], np.float64).reshape(-1, 1)
        return 1 / (1 + np.exp(np.clip(self.thresholds - scores, -60, 60)))


def fit(buckets: list[np.ndarray], grades: np.ndarray, epochs: int = 20, decay: float = 1e-4,
        signal: float = 4.0) -> Model:
    """Maximum likelihood by Adagrad on mini-batches; a tenth is held out and sets the cut.

    A bucket keeps weight 0 if it is met in fewer than three texts, or if its texts pass no threshold more
    or less often than all do, within `signal` standard errors: rare words would only be learnt by heart. A grade that no row has
    gets a threshold all the same; without rows every tail is above the cut and all is selected.
    """
    top = 2
    grades = np.asarray(grades, np.int64)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(grades))
    held, used = order[:len(order) // 10], order[len(order) // 10:]
    share = np.array([(np.sum(grades[used] < j) + 1) / (len(used) + 2) for j in range(1, top + 1)])
    thresholds = np.log(share) - np.log1p(-share) + np.arange(top) * 1e-3
    every = np.concatenate([np.empty(0, np.int32), *(buckets[i] for i in used)])
    seen, telling = np.bincount(every, minlength=BUCKETS), np.zeros(BUCKETS, bool)
    for j in range(1, top + 1):
        above = (grades[used] >= j).astype(float)
        sums = np.bincount(every, np.repeat(above, [len(buckets[i]) for i in used]), BUCKETS)
        mean = above.mean() if len(used) else 0.0
        error = np.sqrt(np.maximum(seen * mean * (1 - mean) * (1 - seen / max(1, len(used))), 1e-9))
        telling |= np.abs(sums - seen * mean) >= signal * error
    common = np.flatnonzero((seen >= 3) & telling)
    place = np.full(BUCKETS, -1)
    place[common] = np.arange(len(common))
    rows = [(lambda at: at[at >= 0])(place[b]) for b in buckets]
    weights, squares, tsquares = np.zeros(len(common)), np.full(len(common), 1e-4), np.full(top, 1e-2)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(used), max(1, len(used) // 256)):
            if not len(part):
                continue
            flat = np.concatenate([rows[i] for i in part])
            owner = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            scores = np.bincount(owner, weights[flat], len(part))
            y = grades[part]
            bounds = np.concatenate([[-np.inf], thresholds, [np.inf]])
            high = 1 / (1 + np.exp(-np.clip(bounds[y + 1] - scores, -50, 50)))
            low = 1 / (1 + np.exp(-np.clip(bounds[y] - scores, -50, 50)))
            mass = np.maximum(high - low, 1e-9)
            dh, dl = high * (1 - high) / mass, low * (1 - low) / mass
            grad = np.bincount(flat, ((dh - dl) / len(part))[owner], len(common)) + decay * weights
            squares += grad ** 2
            weights -= 0.3 * grad / np.sqrt(squares)
            tgrad = np.array([(np.sum(dl[y == j + 1]) - np.sum(dh[y == j])) / len(part) for j in range(top)])
            tsquares += tgrad ** 2
            thresholds = np.maximum.accumulate(thresholds - 0.1 * tgrad / np.sqrt(tsquares) + np.arange(top) * 1e-6)
    model = Model(np.zeros(BUCKETS), thresholds, 0.0)
    model.weights[common] = weights
    clean = [buckets[i] for i in held if grades[i] == top]
    if clean:
        model.cut = float(min(0.5, np.quantile(model.tails(clean)[:, -1], 1 - KEEP)))
    return model


def _features(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [pa.array([features(t or b"") for t in batch.column("text").to_pylist()], pa.list_(pa.int32())),
             batch.column("grade")], names=["buckets", "grade"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          sample: int = SAMPLE) -> Model:
    """Fits on up to `sample` labelled documents: grade 0 is toxic, 1 bad but not toxic, 2 clean and good.

    Rows of `labels` without id or quality are left out, a null toxic counts as 0; of several rows for an
    id the lowest grade counts. Documents that share an id are all used.
    """
    toxic = F.coalesce("toxic", F.lit(0)) > 0
    grade = F.when(toxic, 0).when(F.col("quality") <= 0, 1).otherwise(2)
    graded = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.min(grade).alias("grade"))
    picked = first_by_hash(graded, ["doc_id"], sample).withColumnRenamed("doc_id", "__id")
    texts = docs.select(F.col(id_col).cast("long").alias("__doc"), F.col(text_col).cast("binary").alias("text")).join(
        F.broadcast(picked), F.col("__doc") == F.col("__id")).select("text", "grade", "__id")
    rows = texts.select("text", "grade").mapInArrow(_features, "buckets array<int>, grade int").toArrow()
    grades = rows["grade"].to_numpy()
    # views of one flat array: lists of numbers would take ten times the memory
    lists = rows["buckets"].combine_chunks()
    flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    buckets = [flat[a - ends[0]:b - ends[0]] for a, b in zip(ends[:-1], ends[1:])] if len(grades) else []
    # tasks end in any order
    order = sorted(range(len(grades)), key=lambda i: (int(grades[i]), buckets[i].tobytes()))
    return fit([buckets[i] for i in order], grades[order])


def _score(model: Model):
    model = Model(model.weights.astype(np.float32), model.thresholds, model.cut)

    def run(batches):
        for batch in batches:
            tails = model.tails([features(t or b"") for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(tails.sum(axis=1).round(6)),
                 *[pa.array(tails[:, j].round(6)) for j in range(tails.shape[1])],
                 pa.array(tails[:, -1] >= model.cut)],
                names=["doc_id", "text_key", "expected_grade", "p_not_toxic", "p_clean", "selected"])

    return run


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, expected_grade (0 to 2), p_not_toxic, p_clean and selected, for every row.

    A null text counts as empty and gets the grade of a text without words. Repeated rows and rows without
    id are graded each for itself. Extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"),
                       F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_score(model), "doc_id long, text_key long, expected_grade double, p_not_toxic double, "
                                          "p_clean double, selected boolean")


def keep_selected(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the model selects, all columns; no join, the filter runs where the rows are.

    A null text is judged as an empty one; repeated rows and rows without id are judged each for itself.
    """
    model = Model(model.weights.astype(np.float32), model.thresholds, model.cut)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(model.tails([features(t) for t in texts])[:, -1] >= model.cut))

    return docs.mapInArrow(run, docs.schema)
