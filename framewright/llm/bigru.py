"""A bidirectional gated recurrent network over bytes, in numpy.

Training is backpropagation through time with Adam; inference walks all
segments of a batch together, one position a step, and labels every position.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place: 0.5 * tanh(x / 2) + 0.5."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class ByteGRU:
    """Gates r and z, candidate n: h' = n + z * (h - n), n = tanh(x_n + r * (h U_n))."""

    def __init__(self, classes: int, hidden: int = 8, seed: int = 1):
        rng = np.random.default_rng(seed)
        h, w = hidden, {}
        for d in "fb":
            w[f"{d}_xg"] = rng.normal(0, 0.3, (256, 2 * h))
            w[f"{d}_xn"] = rng.normal(0, 0.3, (256, h))
            w[f"{d}_ug"] = rng.normal(0, 1 / np.sqrt(h), (h, 2 * h))
            w[f"{d}_un"] = rng.normal(0, 1 / np.sqrt(h), (h, h))
            w[f"{d}_o"] = rng.normal(0, 0.3, (h, classes))
        w["o"] = np.zeros(classes)
        self.w = {k: v.astype(np.float32) for k, v in w.items()}
        self.hidden, self.classes = h, classes

    # Training: x is (steps, batch) of bytes, y (batch) of classes, mask (steps, batch) of weights.

    def _walk(self, d: str, x: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        w, h, seen = self.w, np.zeros((x.shape[1], self.hidden), np.float32), [None] * len(x)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g = _sigmoid(h @ w[f"{d}_ug"] + w[f"{d}_xg"][x[t]])
            r, z = g[:, : self.hidden], g[:, self.hidden :]
            m = h @ w[f"{d}_un"]
            n = np.tanh(w[f"{d}_xn"][x[t]] + r * m)
            new = n + z * (h - n)
            seen[t] = (h, r, z, m, n, new)
            h = new
        return seen

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        w, steps = self.w, len(x)
        seen = {d: self._walk(d, x) for d in "fb"}
        state = {d: np.stack([s[5] for s in seen[d]]) for d in "fb"}
        logits = state["f"] @ w["f_o"] + state["b"] @ w["b_o"] + w["o"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        rows = np.arange(x.shape[1])
        loss = float(-(np.log(p[:, rows, y] + 1e-9) * mask).sum() / mask.sum())
        back = p
        back[:, rows, y] -= 1
        back *= (mask / mask.sum())[:, :, None]
        grad = {"o": back.sum(axis=(0, 1))}
        for d in "fb":
            grad[f"{d}_o"] = np.einsum("tbh,tbc->hc", state[d], back)
            inward = back @ w[f"{d}_o"].T
            dh = np.zeros((x.shape[1], self.hidden), np.float32)
            dug, dun = np.zeros_like(w[f"{d}_ug"]), np.zeros_like(w[f"{d}_un"])
            gates, cands = np.zeros((*x.shape, 2 * self.hidden), np.float32), np.zeros((*x.shape, self.hidden), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                h, r, z, m, n, _ = seen[d][t]
                dh = dh + inward[t]
                dn = dh * (1 - z) * (1 - n * n)
                dg = np.concatenate([dn * m * r * (1 - r), dh * (h - n) * z * (1 - z)], axis=1)
                dm = dn * r
                dug += h.T @ dg
                dun += h.T @ dm
                gates[t], cands[t] = dg, dn
                dh = dh * z + dg @ w[f"{d}_ug"].T + dm @ w[f"{d}_un"].T
            grad[f"{d}_ug"], grad[f"{d}_un"] = dug, dun
            flat = x.ravel()
            order = np.argsort(flat, kind="stable")
            used, at = np.unique(flat[order], return_index=True)
            for name, values in (("xg", gates), ("xn", cands)):
                g = np.zeros_like(w[f"{d}_{name}"])
                g[used] = np.add.reduceat(values.reshape(len(flat), -1)[order], at, axis=0)
                grad[f"{d}_{name}"] = g
        return loss, grad

    def fit(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, steps: int = 260, batch: int = 128, rate: float = 0.02, seed: int = 1) -> list[float]:
        """Adam over batches with as many rows of each class; ``x`` and ``mask`` are (steps, rows)."""
        rng, first, second, losses = np.random.default_rng(seed), {}, {}, []
        of = [np.flatnonzero(y == c) for c in range(self.classes)]
        for k in range(1, steps + 1):
            rows = np.concatenate([rng.choice(r, max(1, batch // self.classes)) for r in of if len(r)])
            loss, grad = self.gradients(x[:, rows], y[rows], mask[:, rows])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for name, g in grad.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                second[name] = 0.99 * second.get(name, 0) + 0.01 * g * g
                step = rate * min(1.0, 2 * (1 - k / (steps + 1)))
                self.w[name] = (self.w[name] - step * (first[name] / (1 - 0.9**k)) / (np.sqrt(second[name] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
        return losses

    # Inference

    def pooled(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, rows: int = 1024) -> np.ndarray:
        """Sum over positions of the class probabilities of each segment of ``data``.

        Segments are walked longest first, so the active ones are a prefix and
        no step touches padding.
        """
        out = np.zeros((len(start), self.classes), np.float32)
        order = np.argsort(-length, kind="stable")
        for k in range(0, len(order), rows):
            own = order[k : k + rows]
            out[own] = self._pooled(data, start[own], length[own])
        return out

    def _pooled(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        w, h, steps, n = self.w, self.hidden, int(length[0]), len(start)
        x = data[np.minimum(start[None, :] + np.arange(steps)[:, None], len(data) - 1)]
        active = np.searchsorted(-length, -np.arange(steps), side="left")
        kept = np.empty((steps, n, h), np.float32)
        total, state = np.zeros((n, self.classes), np.float32), np.zeros((n, h), np.float32)
        for d, walk in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            ug, un, xg, xn = w[f"{d}_ug"], w[f"{d}_un"], w[f"{d}_xg"], w[f"{d}_xn"]
            state[:] = 0
            for t in walk:
                a = active[t]
                s, c = state[:a], x[t, :a]
                g = s @ ug
                g += xg[c]
                _sigmoid(g)
                m = s @ un
                m *= g[:, :h]
                m += xn[c]
                np.tanh(m, out=m)
                s -= m
                s *= g[:, h:]
                s += m
                if d == "f":
                    kept[t, :a] = s
                else:
                    p = kept[t, :a] @ w["f_o"]
                    p += s @ w["b_o"]
                    p += w["o"]
                    np.exp(p, out=p)
                    p /= p.sum(axis=1, keepdims=True)
                    total[:a] += p
        return total
