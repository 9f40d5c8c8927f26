"""Small recurrent networks in numpy: GRU and LSTM layers with backpropagation through time, and Adam.

Sequences of a batch are padded to one length; ``mask`` is 1 within a sequence.
A backward layer reads each sequence reversed within its own length.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def reversal(lengths: np.ndarray, steps: int) -> np.ndarray:
    """Places that turn each sequence around within its length and leave the padding."""
    t = np.arange(steps)[None, :]
    return np.where(t < lengths[:, None], lengths[:, None] - 1 - t, t)


def gru_init(rng: np.random.Generator, hidden: int) -> np.ndarray:
    return (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)


def gru_forward(x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool = False):
    """Hidden states of ``x`` (batch, steps, 3 * hidden: the inputs' part of the gates)."""
    batch, steps, width = x.shape
    k = width // 3
    h = np.zeros((batch, k), np.float32)
    out = np.zeros((batch, steps, k), np.float32)
    saved = []
    for t in range(steps):
        hu = h @ u
        gates = sigmoid(x[:, t, : 2 * k] + hu[:, : 2 * k])
        z, r = gates[:, :k], gates[:, k:]
        n = np.tanh(x[:, t, 2 * k :] + r * hu[:, 2 * k :])
        m = mask[:, t, None]
        if keep:
            saved.append((h, z, r, n, hu[:, 2 * k :]))
        h = np.where(m > 0, (1 - z) * n + z * h, h)
        out[:, t] = h
    return (out, saved) if keep else out


def gru_backward(dout: np.ndarray, mask: np.ndarray, u: np.ndarray, saved: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs' part and of ``u``."""
    batch, steps, k = dout.shape
    dx = np.zeros((batch, steps, 3 * k), np.float32)
    du = np.zeros_like(u)
    dh = np.zeros((batch, k), np.float32)
    for t in reversed(range(steps)):
        h, z, r, n, hn = saved[t]
        m = mask[:, t, None]
        d = (dh + dout[:, t]) * m
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        dx[:, t] = np.concatenate([dz, dr, dn], 1)
        dhu = np.concatenate([dz, dr, dn * r], 1)
        du += h.T @ dhu
        dh = (dh + dout[:, t]) * (1 - m) + d * z + dhu @ u.T
    return dx, du


def gru_scores(x: np.ndarray, inside: np.ndarray, table: np.ndarray, u: np.ndarray, head: np.ndarray, backward: bool) -> np.ndarray:
    """What the states of one direction add to the scores: (steps, classes, batch).

    ``x`` holds symbols (steps, batch), ``table`` the inputs' part of the gates by
    symbol. The states are those of :func:`gru_forward`; sequences lie along the
    rows here, which makes a step several times as fast. Steps that are not
    ``inside`` a sequence, all after its end, leave the state empty.
    """
    steps, batch = x.shape
    k = len(u)
    rows, ut, head = np.ascontiguousarray(table.T, np.float32), np.ascontiguousarray(u.T), np.ascontiguousarray(head.T)
    h = np.zeros((k, batch), np.float32)
    given, hu = np.empty((3 * k, batch), np.float32), np.empty((3 * k, batch), np.float32)
    out = np.empty((steps, len(head), batch), np.float32)
    for t in range(steps)[:: -1 if backward else 1]:
        np.take(rows, x[t], axis=1, out=given, mode="clip")
        np.matmul(ut, h, out=hu)
        gates, n = given[: 2 * k], hu[2 * k :]
        gates += hu[: 2 * k]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        n *= gates[k:]
        n += given[2 * k :]
        np.tanh(n, out=n)
        h -= n
        h *= gates[:k]
        h += n
        if not inside[t].all():
            h *= inside[t]
        np.matmul(head, h, out=out[t])
    return out


def lstm_init(rng: np.random.Generator, hidden: int) -> np.ndarray:
    return (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)


def lstm_forward(x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool = False):
    """Hidden states of ``x`` (batch, steps, 4 * hidden: input, forget, output, candidate)."""
    batch, steps, width = x.shape
    k = width // 4
    h = np.zeros((batch, k), np.float32)
    c = np.zeros((batch, k), np.float32)
    out = np.zeros((batch, steps, k), np.float32)
    saved = []
    for t in range(steps):
        a = x[:, t] + h @ u
        gates = sigmoid(a[:, : 3 * k])
        i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
        g = np.tanh(a[:, 3 * k :])
        m = mask[:, t, None] > 0
        new = np.where(m, f * c + i * g, c)
        s = np.tanh(new)
        if keep:
            saved.append((h, c, i, f, o, g, s))
        h, c = np.where(m, o * s, h), new
        out[:, t] = h
    return (out, saved) if keep else out


def lstm_backward(dout: np.ndarray, mask: np.ndarray, u: np.ndarray, saved: list) -> tuple[np.ndarray, np.ndarray]:
    batch, steps, k = dout.shape
    dx = np.zeros((batch, steps, 4 * k), np.float32)
    du = np.zeros_like(u)
    dh = np.zeros((batch, k), np.float32)
    dc = np.zeros((batch, k), np.float32)
    for t in reversed(range(steps)):
        h, c, i, f, o, g, s = saved[t]
        m = mask[:, t, None]
        d = (dh + dout[:, t]) * m
        cell = (dc + d * o * (1 - s * s)) * m
        da = np.concatenate([cell * g * i * (1 - i), cell * c * f * (1 - f), d * s * o * (1 - o), cell * i * (1 - g * g)], 1)
        dx[:, t] = da
        du += h.T @ da
        dh = (dh + dout[:, t]) * (1 - m) + da @ u.T
        dc = dc * (1 - m) + cell * f
    return dx, du


class Adam:
    def __init__(self, params: Params, rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: Params) -> None:
        self.t += 1
        scale = min(1.0, 5.0 / (1e-9 + float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.params[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(self.params[k].dtype)
