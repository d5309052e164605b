"""A small network trained by Spark: gradients are summed in tasks, the driver only moves the weights.

An epoch is one pass over the rows for each mini-batch: every task adds up the gradient of its rows and the losses, one
row for each weight leaves it, and they are summed, by Spark where there are many tasks. The held-out loss of each epoch
decides: the best weights are kept, and training stops when it has made no progress for `patience` epochs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vectide.session import cut_lineage

# Hours between two trainings and the examples that one needs.
RETRAIN_HOURS, MINIMUM_EXAMPLES = 24.0, 50
HELD_OUT = 0.2
# Parts whose sums the driver adds up itself; more are summed by Spark first.
FEW_PARTS = 64
# Rows that a task should have at least.
PART_ROWS = 20_000
# Share, and least amount, by which the held-out loss must fall to count as progress.
PROGRESS, LEAST_PROGRESS = 1e-4, 1e-6


def training_due(last_trained_us: int | None, as_of_us: int, examples: int, hours: float = RETRAIN_HOURS,
                 minimum: int = MINIMUM_EXAMPLES) -> bool:
    """Whether to train: enough examples, and no model yet or one older than `hours`."""
    old = last_trained_us is None or as_of_us - last_trained_us > hours * 3_600_000_000
    return old and examples >= minimum


def held_out(key: Column | str, share: float = HELD_OUT) -> Column:
    """True for the keys that are kept from training; by a hash that any SQL engine has."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 4), 16, 10).cast("int") % 1000 < int(share * 1000)


@dataclass
class Network:
    """Weights of a network with one hidden layer; the output is a chance, or a number if `chance` is off."""

    columns: list[str]
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray  # all of them, flat
    hidden: int
    chance: bool = True
    losses: list[tuple[float, float]] = field(default_factory=list)  # (training, held-out) before each epoch
    best_epoch: int = 0

    @staticmethod
    def size(inputs: int, hidden: int) -> int:
        return (inputs + 1) * hidden + hidden + 1

    def _split(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        n = len(self.columns) * self.hidden
        return (weights[:n].reshape(-1, self.hidden), weights[n:n + self.hidden], weights[n + self.hidden:-1], weights[-1])

    def forward(self, x: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(hidden layer, output) of rows of raw inputs."""
        inner, bias, outer, shift = self._split(self.weights if weights is None else weights)
        layer = np.tanh((x - self.mean) / self.deviation @ inner + bias)
        out = layer @ outer + shift
        return layer, 1 / (1 + np.exp(-np.clip(out, -50, 50))) if self.chance else out

    def loss(self, out: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not self.chance:
            return (out - y) ** 2 / 2
        p = np.clip(out, 1e-12, 1 - 1e-12)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p))

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        """(sum of the rows' gradients, sum of their losses); both losses have the slope output - label."""
        layer, out = self.forward(x)
        outer, slope = self._split(self.weights)[2], out - y
        back = slope[:, None] * outer * (1 - layer ** 2)
        scaled = (x - self.mean) / self.deviation
        return np.concatenate([(scaled.T @ back).reshape(-1), back.sum(axis=0), layer.T @ slope, [slope.sum()]]), float(
            self.loss(out, y).sum())

    def predict(self, rows: DataFrame, out: str) -> DataFrame:
        """`rows` with the output as column `out`; null where an input is null."""

        @F.arrow_udf("double")
        def score(inputs: pa.Array) -> pa.Array:
            values = inputs.flatten().to_numpy(zero_copy_only=False).reshape(len(inputs), -1).astype(np.float64)
            found = self.forward(values)[1] if len(values) else np.empty(0)
            return pa.array(found, mask=np.isnan(found))

        return rows.withColumn(out, score(F.array(*[F.col(c).cast("double") for c in self.columns])))

    def to_json(self) -> str:
        plain = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items()}
        return json.dumps(plain)

    @staticmethod
    def from_json(text: str) -> Network:
        values = json.loads(text)
        for name in ("mean", "deviation", "weights"):
            values[name] = np.array(values[name])
        values["losses"] = [tuple(x) for x in values["losses"]]
        return Network(**values)


def save_network(spark: SparkSession, net: Network, path: str) -> None:
    spark.createDataFrame([(net.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_network(spark: SparkSession, path: str) -> Network:
    return Network.from_json(spark.read.text(path, wholetext=True).first()[0].strip())


def _sums(net: Network, batch: int, batches: int):
    """Per task: the gradient over the batch's training rows, then their loss and number, then those of held-out rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(net.weights) + 4)
        for part in parts:
            x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            y, held, turn = (part.column(c).to_numpy(zero_copy_only=False) for c in ("y", "held", "turn"))
            mine = ~held & (turn % batches == batch)
            grad, loss = net.gradient(x[mine], y[mine])
            total[:-4] += grad
            total[-4:-2] += loss, mine.sum()
            if batch == 0:
                total[-2:] += net.loss(net.forward(x[held])[1], y[held]).sum(), held.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

    return run


def _total(table: DataFrame, parts: int, net: Network, batch: int, batches: int) -> np.ndarray:
    """The sums of all tasks; the driver gets a row for each weight from Spark or, of up to FEW_PARTS tasks, from each."""
    summed = table.mapInArrow(_sums(net, batch, batches), "i int, v double")
    if parts > FEW_PARTS:
        summed = summed.groupBy("i").agg(F.sum("v").alias("v"))
    got = summed.toArrow()
    return np.bincount(got["i"].to_numpy(), got["v"].to_numpy(), len(net.weights) + 4)


def fit(rows: DataFrame, columns: list[str], label: str, key: str, chance: bool = True, hidden: int = 8, epochs: int = 40,
        batches: int = 1, patience: int = 5, rate: float = 0.05, share: float = HELD_OUT, seed: int = 42) -> Network:
    """Adam on the cross-entropy against a soft label or, without `chance`, on the squared error.

    Rows with a null input or label are left out; rows are held out by the hash of `key`, a share of them. Without
    training rows the network answers with the mean of no label; without held-out rows the training loss decides.
    """
    table = cut_lineage(rows.select(
        F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.col(label).cast("double").alias("y"),
        held_out(key, share).alias("held"), F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)).cast("int").alias("turn"),
    ).filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v)) & F.col("y").isNotNull()))
    # no more tasks than the rows are worth, as each epoch starts them all
    table = table.coalesce(max(1, -(-table.count() // PART_ROWS))).persist(StorageLevel.MEMORY_AND_DISK)
    at = [F.col("x")[n] for n in range(len(columns))]
    stats = table.filter(~F.col("held")).agg(*[f(c) for c in at for f in (F.avg, F.stddev_pop)], F.avg("y")).first()
    mean = np.array([stats[2 * n] or 0.0 for n in range(len(columns))])
    spread = np.array([stats[2 * n + 1] or 0.0 for n in range(len(columns))])
    deviation = np.where(spread > 1e-9 * np.maximum(1.0, np.abs(mean)), spread, 1.0)
    size = Network.size(len(columns), hidden)
    net = Network(list(columns), mean, deviation, np.random.default_rng(seed).normal(0, 0.3, size), hidden, chance)
    middle = min(max(stats[-1] or 0.0, 1e-6), 1 - 1e-6) if chance else stats[-1] or 0.0
    net.weights[-hidden - 1:-1] *= 0.01  # the first answer is the mean of the labels
    net.weights[-1] = np.log(middle / (1 - middle)) if chance else middle
    best, lowest, first, second, step = net.weights, np.inf, np.zeros(size), np.zeros(size), 0
    progress, since, parts = float("inf"), 0, table.rdd.getNumPartitions()
    try:
        for epoch in range(epochs + 1):
            for batch in range(batches):
                got = _total(table, parts, net, batch, batches)
                grad, (loss, n, held_loss, held) = got[:-4], got[-4:]
                if not n:
                    return net
                if batch == 0:
                    net.losses.append((float(loss / n), float(held_loss / held if held else loss / n)))
                    if net.losses[-1][1] < lowest:
                        best, lowest, net.best_epoch = net.weights, net.losses[-1][1], epoch
                    if net.losses[-1][1] < progress * (1 - PROGRESS) - LEAST_PROGRESS:
                        progress, since = net.losses[-1][1], epoch
                    if epoch == epochs or epoch - since >= patience:
                        net.weights = best
                        return net
                step += 1
                first, second = 0.9 * first + 0.1 * grad / n, 0.999 * second + 0.001 * (grad / n) ** 2
                net.weights = net.weights - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        return net
    finally:
        table.unpersist()
