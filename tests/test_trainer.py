"""The network that Spark trains: gradients, early stop, held-out rows, the gate before a training."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.operators import predict, trainer


def rows(spark, n=400, noise=0.0, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + noise * rng.normal(size=n))))
    return spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))],
                                 "k long, a double, b double, y double")


@pytest.mark.parametrize("chance", [True, False])
def test_gradient_is_the_slope_of_the_loss(chance):
    rng = np.random.default_rng(2)
    net = trainer.Network(["a", "b"], np.array([0.5, 0.0]), np.array([2.0, 1.0]), rng.normal(size=trainer.Network.size(2, 3)), 3, chance)
    x, y = rng.normal(size=(7, 2)), rng.random(7)
    grad, loss = net.gradient(x, y)
    assert loss == pytest.approx(net.loss(net.forward(x)[1], y).sum())
    for i in range(len(net.weights)):
        step = np.zeros(len(net.weights))
        step[i] = 1e-6
        sides = [net.loss(net.forward(x, net.weights + s * step)[1], y).sum() for s in (1, -1)]
        assert grad[i] == pytest.approx((sides[0] - sides[1]) / 2e-6, rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("parts,batches,few", [(1, 1, 64), (7, 1, 64), (7, 1, 3), (3, 4, 64)])
def test_training_lowers_the_held_out_loss(spark, monkeypatch, parts, batches, few):
    monkeypatch.setattr(trainer, "FEW_PARTS", few)
    monkeypatch.setattr(trainer, "PART_ROWS", 400 // parts)
    table = rows(spark).repartition(parts)
    net = trainer.fit(table, ["a", "b"], "y", "k", batches=batches, epochs=40)
    best = min(h for _, h in net.losses)
    assert net.losses[net.best_epoch][1] == best < net.losses[0][1]
    held = table.filter(trainer.held_out("k"))
    scored = net.predict(held, "p").select("y", "p").toPandas()
    kept = float(net.loss(scored["p"].to_numpy(), scored["y"].to_numpy()).mean())
    assert kept == pytest.approx(best) and np.abs(scored["p"] - scored["y"]).mean() < 0.1


def test_training_stops_early_and_keeps_the_best_weights(spark):
    """Labels without any relation to the inputs: the held-out loss soon rises."""
    table = rows(spark, 60).withColumn("y", F.pmod(F.xxhash64("k"), F.lit(2)).cast("double"))
    net = trainer.fit(table, ["a", "b"], "y", "k", epochs=200, patience=5, hidden=16, rate=0.1)
    assert len(net.losses) < 201 and len(net.losses) - 1 - net.best_epoch <= 5
    assert net.losses[net.best_epoch][1] == min(h for _, h in net.losses)


def test_nulls_empty_tables_and_a_copy(spark, tmp_path):
    table = rows(spark).unionByName(spark.createDataFrame(
        [(-1, None, 1.0, 0.5), (-2, 1.0, float("nan"), 0.5), (-3, 1.0, 1.0, None)], "k long, a double, b double, y double"))
    net, plain = (trainer.fit(t, ["a", "b"], "y", "k", epochs=3, chance=False) for t in (table, rows(spark)))
    assert np.allclose(net.weights, plain.weights)
    got = {r["k"]: r["p"] for r in net.predict(table, "p").filter("k < 0").collect()}
    assert got[-1] is None and got[-2] is None and got[-3] is not None
    empty = trainer.fit(table.limit(0), ["a", "b"], "y", "k")
    assert empty.losses == [] and empty.predict(table.limit(0), "p").count() == 0
    trainer.save_network(spark, net, str(tmp_path / "n"))
    again = trainer.load_network(spark, str(tmp_path / "n"))
    assert again.losses == net.losses and np.array_equal(again.weights, net.weights) and again.columns == net.columns


def test_training_waits_for_a_day_and_fifty_examples(spark):
    hour = 3_600_000_000
    assert trainer.training_due(None, 0, 50) and not trainer.training_due(None, 0, 49)
    assert not trainer.training_due(0, 24 * hour, 50) and trainer.training_due(0, 24 * hour + 1, 50)
    usage = rows(spark, 60).select(F.col("k").alias("embedding_id"), *[F.col("a").alias(c) for c in predict.USAGE_FEATURES], F.col("y").alias("label"))
    assert predict.refit_precompute_classifier(usage, 0, hour) is None
    assert predict.refit_precompute_classifier(usage.limit(20), None, hour) is None
    assert predict.refit_precompute_classifier(usage, None, hour, epochs=2) is not None
