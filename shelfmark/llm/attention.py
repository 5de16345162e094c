"""A small causal self-attention model on subword ids, in numpy."""

from __future__ import annotations

import numpy as np


class Attention:
    """One head over a window: logits of classes = base[row of the previous subword] + (x + attention(x)) @ out.

    x of a subword is a vector of its own, plus its class's, plus its position's.
    Own vectors start at zero, so a subword that was never seen is as its class.
    """

    def __init__(self, base: np.ndarray, group: np.ndarray, width: int = 16, window: int = 64, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = base.shape[1]
        self.base = base.astype(np.float32)
        self.group = group
        self.window = window
        shapes = {"embed": (n, width), "place": (window, width), "q": (width, width), "k": (width, width), "v": (width, width), "out": (width, n)}
        self.weights = {name: (rng.standard_normal(s) * (0.02 if name in ("out", "place") else 0.2)).astype(np.float32) for name, s in shapes.items()}
        self.own = np.zeros((len(group), width), np.float32)
        self.mask = np.where(np.tri(window, dtype=bool), 0.0, -1e9).astype(np.float32)

    def flat(self) -> np.ndarray:
        """All weights but the subwords' own vectors, in a line."""
        return np.concatenate([w.ravel() for w in self.weights.values()])

    def load(self, flat: np.ndarray, own: np.ndarray) -> "Attention":
        at = 0
        for name, w in self.weights.items():
            self.weights[name] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
        self.own = own.astype(np.float32)
        self.__dict__.pop("_tables", None)
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_spaces", "_tables")}

    def _space(self, name: str, *shape: int) -> np.ndarray:
        """An array to write into, kept between calls: fresh pages for each large array would cost more than the arithmetic."""
        spaces = self.__dict__.setdefault("_spaces", {})
        size = int(np.prod(shape))
        kept = spaces.get(name)
        if kept is None or kept.size < size:
            kept = spaces[name] = np.empty(size, np.result_type(*self.weights.values()))
        return kept[:size].reshape(shape)

    def vectors(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of subwords, what queries, keys and values are made with, and these of the subwords: once for each, so that no window needs a product of its own."""
        w = self.weights
        vectors = w["embed"][self.group[ids]] + self.own[ids]
        three = np.concatenate([w["q"] * w["q"].dtype.type(1 / np.sqrt(vectors.shape[1])), w["k"], w["v"]], axis=1)
        return vectors, three, vectors @ three

    def _attend(self, tables: tuple, inputs: np.ndarray, real: np.ndarray | None, first: int) -> tuple:
        """x, queries from position first on, keys, values, attention and hidden states, for windows of places in the tables of ``vectors``.

        real marks positions that hold a token; None says that all do.
        """
        w = self.weights
        vectors, three, made = tables
        n, size = inputs.shape
        width = vectors.shape[1]
        x = np.take(vectors, inputs, axis=0, out=self._space("x", n, size, width), mode="clip")
        x += w["place"][:size]
        y = np.take(made, inputs, axis=0, out=self._space("y", n, size, 3 * width), mode="clip")
        y += w["place"][:size] @ three
        q, k, v = y[:, first:, :width], y[:, :, width : 2 * width], y[:, :, 2 * width :]
        scores = np.matmul(q, k.transpose(0, 2, 1), out=self._space("scores", n, size - first, size))
        scores += self.mask[first:size, :size]
        if real is not None:
            scores += np.where(real, np.float32(0), np.float32(-1e9))[:, None, :]
        if scores.max() > 60:  # else the exponentials are safe as they are
            scores -= scores.max(axis=2, keepdims=True)
        a = np.exp(scores, out=scores)
        total = (a @ np.ones(size, a.dtype))[:, :, None]
        return x, q, k, v, a, total, x[:, first:] + a @ v / total

    def _logits(self, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For hidden states and base rows in a line."""
        n = self.base.shape[1]
        logits = np.matmul(h, self.weights["out"], out=self._space("logits", len(h), n))
        logits += np.take(self.base, rows, axis=0, out=self._space32("rows", len(h), n), mode="clip")
        return logits

    def _space32(self, name: str, *shape: int) -> np.ndarray:
        spaces = self.__dict__.setdefault("_spaces", {})
        size = int(np.prod(shape))
        if name not in spaces or spaces[name].size < size:
            spaces[name] = np.empty(size, np.float32)
        return spaces[name][:size].reshape(shape)

    def log_probs(self, inputs: np.ndarray, rows: np.ndarray, real: np.ndarray | None, targets: np.ndarray, first: int) -> np.ndarray:
        """Natural log-probability of the target class at each position from first on, for windows of ids; rows: the base rows of these positions."""
        if "_tables" not in self.__dict__:  # scoring changes no weights
            self._tables = self.vectors(np.arange(len(self.group)))
        h = self._attend(self._tables, inputs, real, first)[-1].reshape(-1, self.weights["out"].shape[0])
        logits = self._logits(h, rows.ravel())
        t = logits[np.arange(len(h)), targets.ravel()]
        top = np.float32(max(0.0, logits.max() - 60))
        if top:
            logits -= top
        sums = np.exp(logits, out=logits) @ np.ones(logits.shape[1], np.float32)
        return (t - top - np.log(np.maximum(sums, np.float32(1e-30)))).reshape(targets.shape)

    def gradients(self, inputs: np.ndarray, rows: np.ndarray, targets: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Mean loss over real positions, its gradient by every weight, and by the own vectors of the subwords that occur (these, gradient)."""
        w = self.weights
        some, place_of = np.unique(inputs, return_inverse=True)
        x, q, k, v, a, total, h = self._attend(self.vectors(some), place_of.reshape(inputs.shape), real, 0)
        a /= total
        flat = lambda t: t.reshape(-1, t.shape[-1])
        p = self._logits(flat(h), rows.ravel())
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        at = np.arange(len(p))
        loss = -np.log(np.maximum(p[at, targets.ravel()], 1e-30))[real.ravel()].mean()
        p[at, targets.ravel()] -= 1
        p *= (real.ravel() / max(1, real.sum()))[:, None].astype(np.float32)
        scale = w["q"].dtype.type(1 / np.sqrt(x.shape[2]))
        dh = (p @ w["out"].T).reshape(h.shape)
        ds = np.matmul(dh, v.transpose(0, 2, 1), out=self._space("ds", *a.shape))
        ds -= np.einsum("ijk,ijk->ij", ds, a)[:, :, None]
        ds *= a
        dq, dk, dv = ds @ k * scale, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dh
        dx = dh + dq @ w["q"].T + dk @ w["k"].T + dv @ w["v"].T
        own = np.stack([np.bincount(place_of.ravel(), column, len(some)) for column in flat(dx).T], axis=1)
        embed = np.stack([np.bincount(self.group[some], column, len(w["embed"])) for column in own.T], axis=1)
        place = np.zeros_like(w["place"])
        place[: inputs.shape[1]] = dx.sum(axis=0)
        found = {"embed": embed, "place": place, "q": flat(x).T @ flat(dq), "k": flat(x).T @ flat(dk), "v": flat(x).T @ flat(dv), "out": flat(h).T @ p}
        return float(loss), {n: g.astype(w[n].dtype) for n, g in found.items()}, some, own.astype(self.own.dtype)


class Adam:
    """Steps on a model's weights; of the subwords' own vectors only those that occur in a step are touched."""

    def __init__(self, model: Attention, rate: float):
        self.model, self.rate, self.step = model, rate, 0
        self.first = {n: np.zeros_like(x) for n, x in model.weights.items()} | {"own": np.zeros_like(model.own)}
        self.second = {n: np.zeros_like(x) for n, x in self.first.items()}

    def learn(self, inputs: np.ndarray, rows: np.ndarray, targets: np.ndarray, real: np.ndarray) -> float:
        """The loss before the step."""
        self.step += 1
        loss, gradients, some, own = self.model.gradients(inputs, rows, targets, real)
        for n, g in gradients.items():
            self.first[n], self.second[n], moved = self._moved(self.first[n], self.second[n], g)
            self.model.weights[n] = self.model.weights[n] - moved
        self.first["own"][some], self.second["own"][some], moved = self._moved(self.first["own"][some], self.second["own"][some], own)
        self.model.own[some] -= moved
        return loss

    def _moved(self, first: np.ndarray, second: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = first + np.float32(0.1) * (g - first)
        second = second + np.float32(0.01) * (g * g - second)
        return first, second, np.float32(self.rate) * (first / np.float32(1 - 0.9**self.step)) / (np.sqrt(second / np.float32(1 - 0.99**self.step)) + np.float32(1e-8))
