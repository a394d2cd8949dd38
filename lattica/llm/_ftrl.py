"""Follow-the-regularised-leader (proximal) with per-coordinate rates and elastic-net penalties."""

from __future__ import annotations

import numpy as np


class FTRL:
    """``classes`` = 1: logistic regression; more: multinomial.

    State per class and coordinate: z (gradient sum, shifted) and n (squared
    gradient sum).  A weight is zero while |z| <= l1, so only coordinates with
    steady evidence get one.
    """

    def __init__(self, dims: int, classes: int = 1, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((classes, dims))
        self.n = np.zeros((classes, dims))
        self.bias_z, self.bias_n = np.zeros(classes), np.zeros(classes)

    def _weights(self, z, n):
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def bias(self):  # not penalised by l1
        return -self.bias_z / ((self.beta + np.sqrt(self.bias_n)) / self.alpha + self.l2)

    def update(self, at: np.ndarray, value, label: int) -> None:
        """One example: distinct coordinates, their values, and the class (or 0/1)."""
        if len(self.z) == 1:
            return self._update_one(at, value, label)
        z, n = self.z[:, at], self.n[:, at]
        w, b = self._weights(z, n), self.bias()
        s = (w * value).sum(1) + b
        if len(s) == 1:
            err = 1 / (1 + np.exp(-np.clip(s, -35, 35))) - label
        else:
            err = np.exp(s - s.max())
            err /= err.sum()
            err[label] -= 1
        g = err[:, None] * value
        g2 = g * g
        self.z[:, at] = z + g - (np.sqrt(n + g2) - np.sqrt(n)) / self.alpha * w
        self.n[:, at] = n + g2
        self.bias_z += err - (np.sqrt(self.bias_n + err * err) - np.sqrt(self.bias_n)) / self.alpha * b
        self.bias_n += err * err

    def _update_one(self, at, value, label) -> None:
        """The same for one class, on flat arrays."""
        zs, ns = self.z[0], self.n[0]
        z, n = zs[at], ns[at]
        root = np.sqrt(n)
        over = np.abs(z) - self.l1
        w = np.where(over > 0, -np.copysign(over, z) / ((self.beta + root) / self.alpha + self.l2), 0.0)
        b = self.bias()[0]
        err = 1 / (1 + np.exp(-min(max(float((w * value).sum()) + b, -35.0), 35.0))) - label
        g = err * value
        n += g * g
        zs[at] = z + g - (np.sqrt(n) - root) / self.alpha * w
        ns[at] = n
        self.bias_z[0] += err - (np.sqrt(self.bias_n[0] + err * err) - np.sqrt(self.bias_n[0])) / self.alpha * b
        self.bias_n[0] += err * err

    def weights(self) -> np.ndarray:
        out = np.zeros(self.z.shape)
        for z, n, w in zip(self.z, self.n, out, strict=True):
            at = np.flatnonzero(~((z <= self.l1) & (z >= -self.l1)))  # few; no copies of the whole state
            w[at] = self._weights(z[at], n[at])
        return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def platt(raw: np.ndarray, label: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """a, b of sigmoid(a * raw + b), by Newton steps on the log loss with Platt's smoothed targets."""
    pos, neg = float((label == 1).sum()), float((label == 0).sum())
    t = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    mean, std = (float(raw.mean()), float(raw.std()) or 1.0) if len(raw) else (0.0, 1.0)
    x = (raw - mean) / std
    a, b = 0.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(steps):
        p = sigmoid(a * x + b)
        e, h = p - t, p * (1 - p) + 1e-9
        g = np.array([(e * x).sum() + 1e-6 * a, e.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-6, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-9]])
        d = np.linalg.solve(hess, g)
        d *= min(1.0, 2.0 / max(np.abs(d).max(), 1e-12))
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-9:
            break
    return a / std, b - a * mean / std
