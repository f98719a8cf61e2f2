"""Data-parallel training against one plain run in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.operators.mergeable import CalibrationError, MacroF1, evaluate_mergeable
from tidelog.operators.network import Adam, Sgd, evaluate_network, flat, total_sums, train_network
from tidelog.operators.train import FeedForward
from tidelog.session import local_table

START = FeedForward.waves(4, 5, 3, 0.5)
SCHEMA = "role string, step int, x array<double>, label int"


def samples(spark, n=120, steps=2):
    drawn = np.random.default_rng(3)
    x, role = drawn.normal(size=(n, 4)), ["train", "train", "val", "test", "spare"]
    label = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)
    rows = [{"role": role[i % 5], "step": i // 5 % steps, "x": x[i].tolist(), "label": int(label[i])} for i in range(n)]
    return rows, local_table(spark, rows, SCHEMA)


def forward(params, x):
    w1, b1, w2, b2 = params
    hidden = np.maximum(x @ w1 + b1, 0)
    out = hidden @ w2 + b2
    p = np.exp(out)
    return hidden, p / p.sum(axis=1, keepdims=True)


def plain_loss(params, x, y):
    return -np.log(forward(params, x)[1][np.arange(len(y)), y])


def plain_gradient(params, x, y):
    """Central differences of the mean loss, value by value."""
    found = []
    for part in params:
        slope = np.zeros(part.shape)
        for at in np.ndindex(part.shape):
            kept = part[at]
            part[at] = kept + 1e-6
            high = plain_loss(params, x, y).mean()
            part[at] = kept - 1e-6
            slope[at] = (high - plain_loss(params, x, y).mean()) / 2e-6
            part[at] = kept
        found.append(slope)
    return found


def exact_gradient(params, x, y):
    """The mean gradient, row by row."""
    w1, b1, w2, b2 = params
    total = [np.zeros(part.shape) for part in params]
    for row, label in zip(x, y):
        hidden, p = forward(params, row[None])
        error = p[0] - np.eye(len(b2))[label]
        back = (w2 @ error) * (hidden[0] > 0)
        for part, more in zip(total, (np.outer(row, back), back, np.outer(hidden[0], error), error)):
            part += more / len(y)
    return total


def arrays(rows, role, step=None):
    asked = [r for r in rows if r["role"] == role and step in (None, r["step"])]
    return np.array([r["x"] for r in asked]), np.array([r["label"] for r in asked])


def plain_run(rows, epochs, steps, update):
    params = [p.copy() for p in (START.w1, START.b1, START.w2, START.b2)]
    history = []
    for _ in range(epochs):
        losses = []
        for step in range(steps):
            x, y = arrays(rows, "train", step)
            losses.append(plain_loss(params, x, y))
            update(params, exact_gradient(params, x, y))
        history.append((np.concatenate(losses).mean(), plain_loss(params, *arrays(rows, "val")).mean()))
    return params, history


def momentum(rate, share):
    speed = []

    def update(params, gradient):
        speed[:] = [share * s + g for s, g in zip(speed, gradient)] if speed else gradient
        for part, s in zip(params, speed):
            part -= rate * s

    return update


def adam(rate):
    seen = {"t": 0}

    def update(params, gradient):
        seen["t"] += 1
        for i, (part, g) in enumerate(zip(params, gradient)):
            seen["m", i] = 0.9 * seen.get(("m", i), 0) + 0.1 * g
            seen["v", i] = 0.999 * seen.get(("v", i), 0) + 0.001 * g * g
            part -= rate * (seen["m", i] / (1 - 0.9 ** seen["t"])) / (np.sqrt(seen["v", i] / (1 - 0.999 ** seen["t"])) + 1e-8)

    return update


def joined(params):
    return np.concatenate([p.ravel() for p in params])


def test_plain_gradient_is_the_slope(spark):
    rows, _ = samples(spark)
    params = [p.copy() for p in (START.w1, START.b1, START.w2, START.b2)]
    x, y = arrays(rows, "train")
    assert np.allclose(joined(plain_gradient(params, x, y)), joined(exact_gradient(params, x, y)), atol=1e-7)


@pytest.mark.parametrize("optimizer, plain", [(Sgd(0.2, 0.9), momentum(0.2, 0.9)), (Adam(0.05), adam(0.05))])
def test_weights_equal_a_plain_run(spark, optimizer, plain):
    rows, df = samples(spark)
    got = train_network(df, START, optimizer, epochs=3)
    params, history = plain_run(rows, 3, 2, plain)
    assert np.abs(flat(got.network) - joined(params)).max() < 1e-9
    found = {(r["phase"], r["epoch"], r["name"]): r["value"] for r in got.metrics.collect()}
    for epoch, (train, val) in enumerate(history, 1):
        assert found["train", epoch, "loss"] == pytest.approx(train, abs=1e-9)
        assert found["val", epoch, "loss"] == pytest.approx(val, abs=1e-9)
    x, y = arrays(rows, "test")
    assert found["test", 1, "accuracy"] == pytest.approx(100 * (forward(params, x)[1].argmax(axis=1) == y).mean())
    assert len(found) == 14


def test_a_tree_of_tasks_adds_the_same_sums(spark):
    rows, _ = samples(spark)
    df = spark.createDataFrame([(r["x"], r["label"]) for r in rows], "x array<double>, label bigint").repartition(9)
    deep, wide = total_sums(df, START, fan_in=2), total_sums(df, START)
    assert deep[0] == wide[0] == len(rows) and deep[2] == wide[2]
    assert np.allclose(deep[3], wide[3], atol=1e-12) and deep[1] == pytest.approx(wide[1])
    assert total_sums(df.where("label > 9"), START) is None


def test_a_run_goes_on_from_its_state(spark):
    _, df = samples(spark)
    whole = train_network(df, START, Sgd(0.2, 0.9), epochs=2, validate=False)
    half = train_network(df, START, Sgd(0.2, 0.9), validate=False)
    rest = train_network(df, half.network, Sgd(0.2, 0.9), validate=False, state=half.state)
    assert np.allclose(flat(rest.network), flat(whole.network), atol=1e-12)


def test_rows_without_train_leave_the_network(spark):
    _, df = samples(spark)
    got = train_network(df.where("role = 'val'").drop("step"), START, Sgd(0.2))
    assert np.array_equal(flat(got.network), flat(START))
    assert {r["phase"] for r in got.metrics.collect()} == {"val"}
    assert train_network(df.limit(0), START).metrics.count() == 0
    assert evaluate_network(START, df.limit(0)).count() == 0


@pytest.mark.parametrize("bad", ["x = NULL", "x = array(1.0D)", "x = array(1.0D, NULL, 1.0D, 1.0D)", "label = 3", "label = NULL", "step = NULL"])
def test_broken_samples_are_errors(spark, bad):
    name, value = bad.split(" = ")
    df = samples(spark, 10)[1].withColumn(name, F.expr(value).cast(dict(c.split(" ") for c in SCHEMA.split(", "))[name]))
    with pytest.raises(Exception, match="a sample needs 4 values"):
        train_network(df, START)


def test_mergeable_metrics_by_group_and_in_a_tree(spark):
    drawn = np.random.default_rng(5)
    scores, label = drawn.normal(size=(300, 3)), drawn.integers(0, 3, 300)
    group = [None if i % 7 == 0 else "hot" if i % 3 else "rare" for i in range(300)]
    rows = [(group[i], scores[i].tolist(), int(label[i])) for i in range(300)] + [("hot", None, 1), ("rare", [1.0, 2.0, 3.0], None)]
    df = spark.createDataFrame(rows, "part string, scores array<double>, label int").repartition(9)
    asked = {"f1": MacroF1(3), "calibration": CalibrationError(5)}
    for fan_in in (2, 64):
        found = {(r["part"], r["name"]): r["value"] for r in evaluate_mergeable(df, asked, ["part"], fan_in=fan_in).collect()}
        assert len(found) == 6
        for part in (None, "hot", "rare"):
            at = [i for i in range(300) if group[i] == part]
            for name, metric in asked.items():
                assert found[part, name] == pytest.approx(metric.finish(metric.update(metric.init(), scores[at], label[at])))
    whole = {r["name"]: r["value"] for r in evaluate_mergeable(df, asked).collect()}
    guess = scores.argmax(axis=1)
    f1 = [2 * ((guess == c) & (label == c)).sum() / ((guess == c).sum() + (label == c).sum()) for c in range(3)]
    assert whole["f1"] == pytest.approx(np.mean(f1))
    assert evaluate_mergeable(df.limit(0), asked).count() == 0
