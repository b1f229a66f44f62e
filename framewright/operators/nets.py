"""Sequence classifiers in numpy: recurrent, convolutional and attention layers with their own gradients.

Inputs are (rows, steps, features).  A layer keeps what its backward pass needs
from the last forward pass; ``params`` and ``grads`` hold arrays of equal names.
Prediction takes ``PREDICT_ROWS`` rows at a time and keeps nothing of them, so
its memory does not grow with the rows and a fitted network is its weights.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Rows that are predicted together.
PREDICT_ROWS = 256


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Layer:
    #: What a forward pass leaves for the backward pass.
    PASS: tuple[str, ...] = ()

    def __init__(self):
        self.params: dict[str, np.ndarray] = {}
        self.grads: dict[str, np.ndarray] = {}

    def _weights(self, rng: np.random.Generator, **shapes: tuple[int, ...]) -> None:
        for name, shape in shapes.items():
            spread = np.sqrt(6 / (shape[0] + shape[-1])) if len(shape) > 1 else 0.0
            self.params[name] = rng.uniform(-spread, spread, shape) if spread else np.zeros(shape)

    def forward(self, x: np.ndarray, train: bool) -> np.ndarray:
        raise NotImplementedError

    def backward(self, d: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def release(self) -> None:
        """Forget the last pass and its gradients."""
        self.grads = {}
        for name in self.PASS:
            self.__dict__.pop(name, None)


class Dense(Layer):
    PASS = ("x", "y")

    def __init__(self, rng, n: int, m: int, relu: bool = False):
        super().__init__()
        self.relu = relu
        self._weights(rng, w=(n, m), b=(m,))

    def forward(self, x, train):
        self.x = x
        self.y = x @ self.params["w"] + self.params["b"]
        return np.maximum(self.y, 0) if self.relu else self.y

    def backward(self, d):
        d = d * (self.y > 0) if self.relu else d
        flat, out = self.x.reshape(-1, self.x.shape[-1]), d.reshape(-1, d.shape[-1])
        self.grads = {"w": flat.T @ out, "b": out.sum(axis=0)}
        return d @ self.params["w"].T


class Dropout(Layer):
    PASS = ("mask",)

    def __init__(self, rng, share: float):
        super().__init__()
        self.rng, self.share = rng, share

    def forward(self, x, train):
        self.mask = (self.rng.random(x.shape, np.float32) >= self.share).astype(x.dtype) / (1 - self.share) if train and self.share else 1.0
        return x * self.mask

    def backward(self, d):
        return d * self.mask


class Norm(Layer):
    """Normalisation over the batch (running statistics serve prediction) or over the features of each position."""

    PASS = ("axis", "live", "scale", "z")

    def __init__(self, n: int, batch: bool):
        super().__init__()
        self.batch, self.mean, self.var = batch, np.zeros(n), np.ones(n)
        self.params = {"g": np.ones(n), "b": np.zeros(n)}

    def forward(self, x, train):
        self.axis = tuple(range(x.ndim - 1)) if self.batch else (x.ndim - 1,)
        self.live = train or not self.batch
        if self.live:
            mean, var = x.mean(axis=self.axis, keepdims=True), x.var(axis=self.axis, keepdims=True)
            if self.batch:
                self.mean, self.var = 0.9 * self.mean + 0.1 * mean.reshape(-1), 0.9 * self.var + 0.1 * var.reshape(-1)
        else:
            mean, var = self.mean, self.var
        self.scale = 1 / np.sqrt(var + 1e-5)
        self.z = (x - mean) * self.scale
        return self.z * self.params["g"] + self.params["b"]

    def backward(self, d):
        over = tuple(range(d.ndim - 1))
        self.grads = {"g": (d * self.z).sum(axis=over), "b": d.sum(axis=over)}
        d = d * self.params["g"]
        if self.live:
            d = d - d.mean(axis=self.axis, keepdims=True) - self.z * (d * self.z).mean(axis=self.axis, keepdims=True)
        return d * self.scale


class Recurrent(Layer):
    """LSTM or GRU, one way or both; the whole sequence or the last state of each direction."""

    PASS = ("x", "kept")

    def __init__(self, rng, cell: str, n: int, units: int, both: bool, sequences: bool):
        super().__init__()
        self.cell, self.units, self.sequences = cell, units, sequences
        self.ways = ("f", "b") if both else ("f",)
        gates = 4 if cell == "lstm" else 3
        for d in self.ways:
            self._weights(rng, **{f"{d}x": (n, gates * units), f"{d}h": (units, gates * units), f"{d}b": (gates * units,)})
            if cell == "lstm":
                self.params[f"{d}b"][units : 2 * units] = 1.0  # remember at first

    def _order(self, way: str, steps: int) -> list[int]:
        return list(range(steps)) if way == "f" else list(range(steps - 1, -1, -1))

    def forward(self, x, train):
        self.x, self.kept, u, out = x, {}, self.units, []
        for way in self.ways:
            z = x @ self.params[f"{way}x"] + self.params[f"{way}b"]
            h = np.zeros((len(x), u), z.dtype)
            c, states = h, np.zeros((*x.shape[:2], u), z.dtype)
            for t in self._order(way, x.shape[1]):
                m = h @ self.params[f"{way}h"]
                if self.cell == "lstm":
                    a = z[:, t] + m
                    i, f, o, g = _sigmoid(a[:, :u]), _sigmoid(a[:, u : 2 * u]), _sigmoid(a[:, 2 * u : 3 * u]), np.tanh(a[:, 3 * u :])
                    new_c = f * c + i * g
                    tc = np.tanh(new_c)
                    self.kept[way, t] = (h, c, i, f, o, g, tc)
                    h, c = o * tc, new_c
                else:
                    r, k = _sigmoid(z[:, t, :u] + m[:, :u]), _sigmoid(z[:, t, u : 2 * u] + m[:, u : 2 * u])
                    n = np.tanh(z[:, t, 2 * u :] + r * m[:, 2 * u :])
                    self.kept[way, t] = (h, r, k, n, m[:, 2 * u :])
                    h = n + k * (h - n)
                states[:, t] = h
            out.append(states if self.sequences else h)
        return np.concatenate(out, axis=-1)

    def backward(self, d):
        u, steps = self.units, self.x.shape[1]
        dx, self.grads = np.zeros_like(self.x), {}
        for w, way in enumerate(self.ways):
            own = d[..., w * u : (w + 1) * u]
            dz = np.zeros((*self.x.shape[:2], self.params[f"{way}b"].size), self.x.dtype)
            du = np.zeros_like(self.params[f"{way}h"])
            dh = np.zeros((len(d), u), self.x.dtype) if self.sequences else own
            dc = np.zeros((len(d), u), self.x.dtype)
            for t in reversed(self._order(way, steps)):
                dh = dh + own[:, t] if self.sequences else dh
                if self.cell == "lstm":
                    h, c, i, f, o, g, tc = self.kept[way, t]
                    dc = dc + dh * o * (1 - tc * tc)
                    dm = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                    dz[:, t] = dm
                    dh, dc = dm @ self.params[f"{way}h"].T, dc * f
                else:
                    h, r, k, n, mn = self.kept[way, t]
                    dn = dh * (1 - k) * (1 - n * n)
                    dr, dk = dn * mn * r * (1 - r), dh * (h - n) * k * (1 - k)
                    dz[:, t] = np.concatenate([dr, dk, dn], axis=1)
                    dm = np.concatenate([dr, dk, dn * r], axis=1)
                    dh = dh * k + dm @ self.params[f"{way}h"].T
                du += h.T @ dm
            flat = dz.reshape(-1, dz.shape[-1])
            self.grads |= {f"{way}x": self.x.reshape(-1, self.x.shape[-1]).T @ flat, f"{way}h": du, f"{way}b": flat.sum(axis=0)}
            dx += dz @ self.params[f"{way}x"].T
        return dx


class Convolution(Layer):
    """Three steps wide, zeros beyond both ends, then the larger of each two steps."""

    PASS = ("steps", "cols", "y", "first")

    def __init__(self, rng, n: int, m: int):
        super().__init__()
        self._weights(rng, w=(3 * n, m), b=(m,))

    def forward(self, x, train):
        self.steps = x.shape[1]
        wide = np.pad(x, ((0, 0), (1, 1), (0, 0)))
        self.cols = np.concatenate([wide[:, k : k + self.steps] for k in range(3)], axis=2)
        self.y = np.maximum(self.cols @ self.params["w"] + self.params["b"], 0)
        pairs = self.y[:, : self.steps // 2 * 2].reshape(len(x), -1, 2, self.y.shape[2])
        self.first = pairs[:, :, :1] >= pairs[:, :, 1:]
        return pairs.max(axis=2)

    def backward(self, d):
        up = np.concatenate([d[:, :, None] * self.first, d[:, :, None] * ~self.first], axis=2).reshape(len(d), -1, d.shape[2])
        up = np.pad(up, ((0, 0), (0, self.steps - up.shape[1]), (0, 0))) * (self.y > 0)
        self.grads = {"w": self.cols.reshape(-1, self.cols.shape[2]).T @ up.reshape(-1, up.shape[2]), "b": up.sum(axis=(0, 1))}
        cols = up @ self.params["w"].T
        n = cols.shape[2] // 3
        wide = np.zeros((len(d), self.steps + 2, n), cols.dtype)
        for k in range(3):
            wide[:, k : k + self.steps] += cols[:, :, k * n : (k + 1) * n]
        return wide[:, 1:-1]


class Attention(Layer):
    """Every position attends to all, by several heads."""

    PASS = ("x", "q", "k", "v", "a", "mixed")

    def __init__(self, rng, n: int, heads: int, size: int):
        super().__init__()
        self.heads, self.size = heads, size
        self._weights(rng, q=(n, heads * size), k=(n, heads * size), v=(n, heads * size), o=(heads * size, n))

    def _split(self, x):
        return x.reshape(*x.shape[:2], self.heads, self.size).transpose(0, 2, 1, 3)

    def _join(self, x):
        return x.transpose(0, 2, 1, 3).reshape(x.shape[0], x.shape[2], -1)

    def forward(self, x, train):
        self.x = x
        self.q, self.k, self.v = (self._split(x @ self.params[p]) for p in "qkv")
        s = self.q @ self.k.transpose(0, 1, 3, 2) / self.size**0.5
        s = np.exp(s - s.max(axis=-1, keepdims=True))
        self.a = s / s.sum(axis=-1, keepdims=True)
        self.mixed = self._join(self.a @ self.v)
        return self.mixed @ self.params["o"]

    def backward(self, d):
        flat = lambda x: x.reshape(-1, x.shape[-1])
        dm = self._split(d @ self.params["o"].T)
        da = dm @ self.v.transpose(0, 1, 3, 2)
        ds = self.a * (da - (da * self.a).sum(axis=-1, keepdims=True)) / self.size**0.5
        each = {"q": self._join(ds @ self.k), "k": self._join(ds.transpose(0, 1, 3, 2) @ self.q), "v": self._join(self.a.transpose(0, 1, 3, 2) @ dm)}
        self.grads = {"o": flat(self.mixed).T @ flat(d)} | {p: flat(self.x).T @ flat(g) for p, g in each.items()}
        return sum(g @ self.params[p].T for p, g in each.items())


class Residual(Layer):
    """x plus what the inner layers make of it."""

    def __init__(self, *inner: Layer):
        super().__init__()
        self.inner = inner
        self.params = {f"{i}.{k}": v for i, layer in enumerate(inner) for k, v in layer.params.items()}

    def forward(self, x, train):
        y = x
        for i, layer in enumerate(self.inner):
            layer.params = {k: self.params[f"{i}.{k}"] for k in layer.params}
            y = layer.forward(y, train)
        return x + y

    def backward(self, d):
        inward, self.grads = d, {}
        for i in range(len(self.inner) - 1, -1, -1):
            inward = self.inner[i].backward(inward)
            self.grads |= {f"{i}.{k}": v for k, v in self.inner[i].grads.items()}
        return d + inward

    def release(self):
        super().release()
        for layer in self.inner:
            layer.release()


class Reshape(Layer):
    """All steps in one row, or their mean."""

    PASS = ("shape",)

    def __init__(self, mean: bool):
        super().__init__()
        self.mean = mean

    def forward(self, x, train):
        self.shape = x.shape
        return x.mean(axis=1) if self.mean else x.reshape(len(x), -1)

    def backward(self, d):
        return np.repeat(d[:, None] / self.shape[1], self.shape[1], axis=1) if self.mean else d.reshape(self.shape)


def _head(rng, n: int, dropout: float, classes: int) -> list[Layer]:
    return [Norm(n, True), Dropout(rng, dropout), Dense(rng, n, 64, True), Dropout(rng, 0.3), Dense(rng, 64, 32, True), Dense(rng, 32, classes)]


def build(name: str, steps: int, features: int, classes: int = 3, dropout: float = 0.4, seed: int = 42) -> list[Layer]:
    """The layers of bilstm, lstm, bigru, cnn1d or transformer."""
    rng = np.random.default_rng(seed)
    if name in ("bilstm", "lstm", "bigru"):
        cell, both = name.removeprefix("bi"), name.startswith("bi")
        ways = 2 if both else 1
        return [Recurrent(rng, cell, features, 64, both, True), Dropout(rng, dropout), Recurrent(rng, cell, 64 * ways, 32, both, False), *_head(rng, 32 * ways, dropout, classes)]
    if name == "cnn1d":
        return [Convolution(rng, features, 64), Convolution(rng, 64, 128), Reshape(False), *_head(rng, steps // 2 // 2 * 128, dropout, classes)]
    if name == "transformer":
        blocks: list[Layer] = []
        for _ in range(2):
            blocks.append(Residual(Norm(64, False), Attention(rng, 64, 4, 64), Dropout(rng, dropout)))
            blocks.append(Residual(Norm(64, False), Dense(rng, 64, 128, True), Dropout(rng, dropout), Dense(rng, 128, 64)))
        return [Dense(rng, features, 64), *blocks, Reshape(True), Dropout(rng, dropout), Dense(rng, 64, 64, True), Dense(rng, 64, classes)]
    raise KeyError(f"no network {name!r}")


class Adam:
    """Moments of the gradients of each weight and the steps that made them."""

    def __init__(self):
        self.first, self.second, self.steps = {}, {}, 0.0

    def move(self, network: Network, rate: float) -> None:
        """One step along the gradients of the network's last backward pass."""
        self.steps += 1
        for i, layer in enumerate(network.layers):
            for name, g in layer.grads.items():
                key = f"{i}/{name}"
                m = self.first[key] = 0.9 * self.first.get(key, 0) + 0.1 * g
                v = self.second[key] = 0.999 * self.second.get(key, 0) + 0.001 * g * g
                layer.params[name] = (layer.params[name] - rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-7)).astype(network.dtype)


class Network:
    """Layers under a softmax, trained by Adam on the cross entropy.

    The rate is halved after ``patience`` epochs without a better validation loss
    and training stops after ``stop``; the best weights are kept.
    """

    def __init__(self, name: str, steps: int, features: int, classes: int = 3, seed: int = 42, dtype=np.float32, **options):
        self.kind = {"name": name, "steps": steps, "features": features, "classes": classes, "seed": seed}
        self.layers, self.seed = build(name, steps, features, classes, seed=seed, **options), seed
        for layer in self.layers:
            layer.params = {k: v.astype(dtype) for k, v in layer.params.items()}
        self.dtype, self.history = dtype, []

    def _passed(self, x: np.ndarray, train: bool) -> np.ndarray:
        y = x.astype(self.dtype)
        for layer in self.layers:
            y = layer.forward(y, train)
            if not train:
                layer.release()
        y = np.exp(y - y.max(axis=1, keepdims=True))
        return y / y.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._passed(x[at : at + PREDICT_ROWS], False) for at in range(0, max(len(x), 1), PREDICT_ROWS)])

    def loss_and_gradients(self, x: np.ndarray, y: np.ndarray) -> float:
        p = self._passed(x, True)
        d = p.copy()
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        for layer in reversed(self.layers):
            d = layer.backward(d)
        return float(-np.log(p[np.arange(len(y)), y] + 1e-12).mean())

    def state(self) -> dict[str, np.ndarray]:
        out = {f"{i}/{k}": v for i, layer in enumerate(self.layers) for k, v in layer.params.items()}
        return out | {f"{i}/~{k}": getattr(layer, k) for i, layer in enumerate(self.layers) if isinstance(layer, Norm) for k in ("mean", "var")}

    def restore(self, state: dict[str, np.ndarray]) -> None:
        for key, value in state.items():
            i, name = key.split("/")
            if name.startswith("~"):
                setattr(self.layers[int(i)], name[1:], value)
            else:
                self.layers[int(i)].params[name] = value

    def packed(self, adam: Adam) -> np.ndarray:
        """Weights, running statistics and moments in one row of doubles."""
        return np.concatenate([p[k].ravel() for p in (self.state(), adam.first, adam.second) for k in sorted(p)]).astype(float)

    def unpack(self, flat: np.ndarray, adam: Adam) -> None:
        """Take what :meth:`packed` has written, or a mean of such rows."""
        state, at = self.state(), 0
        weights = {k: v for k, v in state.items() if "~" not in k}
        taken: list[dict[str, np.ndarray]] = []
        for like in (state, weights, weights):
            taken.append({})
            for k in sorted(like):
                taken[-1][k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(like[k].dtype)
                at += like[k].size
        self.restore(taken[0])
        adam.first, adam.second = taken[1:]

    def reseed(self, rng: np.random.Generator) -> None:
        """Dropout draws from ``rng`` from now on."""
        for layer in self.layers:
            for one in (layer, *getattr(layer, "inner", ())):
                if isinstance(one, Dropout):
                    one.rng = rng

    def epoch(self, x: np.ndarray, y: np.ndarray, adam: Adam, rng: np.random.Generator, rate: float, batch: int = 64) -> list[float]:
        """One pass over the rows in an order of ``rng``: the loss of each batch."""
        order, losses = rng.permutation(len(y)), []
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            losses.append(self.loss_and_gradients(x[rows], y[rows]))
            adam.move(self, rate)
        return losses

    def scores(self, x: np.ndarray, y: np.ndarray) -> tuple[float, int]:
        """Sum of the rows' losses and how many are predicted right."""
        p = self.probabilities(x)
        return float(-np.log(p[np.arange(len(y)), y] + 1e-12).sum(dtype=float)), int((p.argmax(axis=1) == y).sum())

    def fit_by(self, learn: Callable[[int, float], float], score: Callable[[], list[tuple[float, float]]], epochs: int = 50, rate: float = 1e-3, stop: int = 8, patience: int = 3, least: float = 1e-6) -> Network:
        """``learn(epoch, rate)`` makes an epoch's steps and returns its loss, ``score()`` the (loss, accuracy) of the training and the validation rows."""
        best, best_loss, since, waited = self.state(), np.inf, 0, 0
        for epoch in range(epochs):
            loss = learn(epoch, rate)
            (_, accuracy), (val, val_accuracy) = score()
            self.history.append({"epoch": epoch + 1, "loss": loss, "accuracy": accuracy, "val_loss": val, "val_accuracy": val_accuracy})
            if val < best_loss:
                best, best_loss, since, waited = self.state(), val, 0, 0
                continue
            since, waited = since + 1, waited + 1
            if waited >= patience:
                rate, waited = max(rate / 2, least), 0
            if since >= stop:
                break
        self.restore(best)
        return self

    def fit(self, x, y, val_x, val_y, batch: int = 64, **options) -> Network:
        """Fit on arrays; ``options`` are those of :meth:`fit_by`."""
        rng, adam = np.random.default_rng(self.seed), Adam()
        mean = lambda x, y: tuple(v / len(y) if len(y) else np.nan for v in self.scores(x, y))
        return self.fit_by(lambda _, rate: float(np.mean(self.epoch(x, y, adam, rng, rate, batch))), lambda: [mean(x, y), mean(val_x, val_y)], **options)

    def save(self, path: str) -> None:
        np.savez(path, **{f"kind~{k}": np.array(v) for k, v in self.kind.items()}, **self.state())

    @classmethod
    def load(cls, path: str) -> Network:
        with np.load(path) as data:
            kind = {k[5:]: data[k].item() for k in data.files if k.startswith("kind~")}
            out = cls(**kind)
            out.restore({k: data[k] for k in data.files if not k.startswith("kind~")})
        return out
