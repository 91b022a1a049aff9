"""The language model's arithmetic costs less than the plain form of it, with the same results."""

import time

import numpy as np
import pytest

from symgraph.llm import recurrent_lm as L


def plain_step(net, a, h):
    """A row for each lane."""
    n, u = net.hidden, h @ net.p["u"]
    gates, new = a[:, : 2 * n], a[:, 2 * n :]
    gates += u[:, : 2 * n]
    gates *= 0.5
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    new += a[:, n : 2 * n] * u[:, 2 * n :]
    np.tanh(new, out=new)
    out = h - new
    out *= gates[:, :n]
    out += new
    return out


def test_step_costs_less_than_plain_rows():
    L.one_thread()
    net, rng = L.Network(16, np.ones(100)), np.random.default_rng(0)
    a, h = rng.standard_normal((512, 48)).astype(np.float32), rng.uniform(-1, 1, (512, 16)).astype(np.float32)
    assert net.step(a.copy(), h)[0] == pytest.approx(plain_step(net, a.copy(), h), abs=1e-5)

    def seconds(f):
        rows = [a.copy() for _ in range(10)]
        t = time.thread_time()
        for x in rows:
            f(x)
        return time.thread_time() - t

    own, plain = zip(*((seconds(lambda x: net.step(x, h)), seconds(lambda x: plain_step(net, x, h))) for _ in range(60)))
    assert min(own) < 0.85 * min(plain)


def test_extreme_gates():
    net = L.Network(2, np.ones(4))
    a = np.array([[200, 200, 1, -200, -200, 1], [-200, -200, 1, 200, 200, 1]], np.float32)[:, [0, 3, 1, 4, 2, 5]]
    out = net.step(a, np.full((2, 2), 0.5, np.float32))[0]
    assert np.isfinite(out).all() and out[0, 0] == 0.5 and out[1, 1] == 0.5


def test_gradients_stop_where_a_state_starts_anew():
    """Two documents in one lane train like two documents in two lanes."""
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 12, 6), rng.integers(0, 12, 6)
    nets = [L.Network(4, np.arange(12, 0, -1.0)) for _ in range(2)]
    for net in nets:
        net.p = {k: a.astype(np.float64) for k, a in net.p.items()}
        net.g = {k: a.astype(np.float64) for k, a in net.g.items()}
    none = np.zeros(0, np.int64)
    nets[0].window([x[i : i + 1] for i in range(6)], [y[i : i + 1] for i in range(6)], np.zeros((1, 4)), 0.1, 1, [np.zeros(1, np.int64) if i in (0, 3) else none for i in range(6)])
    nets[1].window([x[[i, i + 3]] for i in range(3)], [y[[i, i + 3]] for i in range(3)], np.zeros((2, 4)), 0.1, 1)
    for k in nets[0].p:
        assert nets[0].p[k] == pytest.approx(nets[1].p[k], abs=1e-12), k


def test_order_is_stable():
    ids = np.random.default_rng(0).integers(0, 300, 5000) * 1000
    assert (L.order_of(ids) == np.argsort(ids, kind="stable")).all() and len(L.order_of(ids[:0])) == 0
