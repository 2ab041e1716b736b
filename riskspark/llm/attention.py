"""One causal self-attention layer over a small inventory of ids, trained and run in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

WINDOW, CONTEXT = 32, 8
WIDTH = 16
_WINDOWS_AT_ONCE = 256
_ROWS_AT_ONCE = 512
#: exponents up to here need no shift in single precision
_SAFE = 40.0


def _rows(m: np.ndarray) -> np.ndarray:
    return m.reshape(-1, m.shape[-1])


def _sums(m: np.ndarray) -> np.ndarray:
    return m @ np.ones(m.shape[1], m.dtype)


class Attention:
    """Predicts the next id from up to ``WINDOW`` ids before it; id ``kinds`` marks the beginning."""

    def __init__(self, kinds: int, frequency: np.ndarray | None = None, seed: int = 3):
        rng = np.random.default_rng(seed)
        share = np.full(kinds, 1.0) if frequency is None else np.asarray(frequency, float) + 1.0
        small = lambda *shape: rng.normal(0, 0.15, shape).astype(np.float32)
        self.kinds = kinds
        self._kept: dict[str, np.ndarray] = {}
        self.params = {
            "ids": small(kinds + 1, WIDTH), "places": small(WINDOW, WIDTH), "query": small(WIDTH, WIDTH),
            "key": small(WIDTH, WIDTH), "value": small(WIDTH, WIDTH), "mix": small(WIDTH, WIDTH),
            "out": small(WIDTH, kinds) * np.float32(0.3), "bias": np.log(share / share.sum()).astype(np.float32)}
        self.mask = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
        self.seen = np.tril(np.ones((WINDOW, WINDOW), np.float32))

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array to write over, kept from call to call: new ones of this size cost page faults."""
        size = math.prod(shape)
        if name not in self._kept or self._kept[name].size < size:
            self._kept[name] = np.empty(size, np.float32)
        return self._kept[name][:size].reshape(shape)

    def __getstate__(self):
        return self.__dict__ | {"_kept": {}}

    def _attend(self, ids: np.ndarray) -> dict[str, np.ndarray]:
        """The layer's values, valid until the next call."""
        p, shape, square = self.params, (*ids.shape, WIDTH), (*ids.shape, ids.shape[1])
        x = np.take(p["ids"], ids, axis=0, out=self._room("x", *shape), mode="clip")
        x += p["places"]
        rows = _rows(x)  # one product over all windows
        q, k, v = (np.matmul(rows, p[name], out=self._room(name, *rows.shape)).reshape(shape) for name in ("query", "key", "value"))
        scaled = np.multiply(q, np.float32(WIDTH ** -0.5), out=self._room("scaled", *shape))
        weights = np.matmul(scaled, k.transpose(0, 2, 1), out=self._room("weights", *square))
        if weights.max(initial=0) > _SAFE or weights.min(initial=0) < -_SAFE:
            weights += self.mask
            weights -= weights.max(axis=2, keepdims=True)
        np.exp(weights, out=weights)
        weights *= self.seen
        weights /= _sums(_rows(weights)).reshape(*ids.shape, 1)
        a = np.matmul(weights, v, out=self._room("a", *shape))
        h = np.matmul(_rows(a), p["mix"], out=self._room("h", *rows.shape)).reshape(shape)
        h += x
        return {"x": x, "q": q, "k": k, "v": v, "weights": weights, "a": a, "h": h}

    def _exponents(self, h: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray | np.float32]]:
        """For slices of the rows of ``h``: logits, an array for their exponents, and what to
        subtract from the logits before. Both arrays are written over for the next slice."""
        both = self._room("logits", 2, min(len(h), _ROWS_AT_ONCE), self.kinds)
        for at in range(0, len(h), _ROWS_AT_ONCE):
            part = h[at:at + _ROWS_AT_ONCE]
            logits, exponents = both[:, :len(part)]
            np.matmul(part, self.params["out"], out=logits)
            logits += self.params["bias"]
            top = np.float32(0)
            if logits.max(initial=0) > _SAFE or logits.min(initial=0) < -_SAFE:
                top = logits.max(axis=1)
                np.subtract(logits, top[:, None], out=exponents)
                np.exp(exponents, out=exponents)
            else:
                np.exp(logits, out=exponents)
            yield slice(at, at + len(part)), logits, exponents, top

    def log10(self, ids: np.ndarray, targets: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """log10 probability of the wanted targets, in order."""
        h, aims = self._attend(ids)["h"][wanted], targets[wanted]
        found = np.empty(len(h))
        for part, logits, exponents, top in self._exponents(h):
            found[part] = logits[np.arange(len(logits)), aims[part]] - top - np.log(_sums(exponents))
        return found / np.log(10)

    def gradients(self, ids: np.ndarray, targets: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
        p, s = self.params, self._attend(ids)
        shape = s["x"].shape
        at = np.flatnonzero(wanted)
        h, aims, scale = np.take(_rows(s["h"]), at, axis=0), targets.ravel()[at], np.float32(1 / max(1, len(at)))
        g = {"out": np.zeros_like(p["out"]), "bias": np.zeros_like(p["bias"])}
        dh = self._room("dh", ids.size, WIDTH)
        dh.fill(0)
        for part, _, d, _ in self._exponents(h):
            d *= (scale / _sums(d))[:, None]
            d[np.arange(len(d)), aims[part]] -= scale
            g["out"] += h[part].T @ d
            g["bias"] += np.ones(len(d), np.float32) @ d
            dh[at[part]] = d @ p["out"].T
        g["mix"] = _rows(s["a"]).T @ dh
        da = np.matmul(dh, p["mix"].T, out=self._room("da", *dh.shape)).reshape(shape)
        weights = s["weights"]
        dv = np.matmul(weights.transpose(0, 2, 1), da, out=self._room("dv", *shape))
        ds = np.matmul(da, s["v"].transpose(0, 2, 1), out=self._room("ds", *weights.shape))
        ds -= np.einsum("bij,bij->bi", ds, weights)[:, :, None]
        ds *= weights
        ds *= np.float32(WIDTH ** -0.5)
        dq = np.matmul(ds, s["k"], out=self._room("dq", *shape))
        dk = np.matmul(ds.transpose(0, 2, 1), s["q"], out=self._room("dk", *shape))
        dx, x = dh, _rows(s["x"])
        for name, part in (("query", dq), ("key", dk), ("value", dv)):
            g[name] = x.T @ _rows(part)
            dx += np.matmul(_rows(part), p[name].T, out=self._room("more", *dh.shape))
        g["places"] = dx.reshape(shape).sum(axis=0)
        g["ids"] = np.zeros_like(p["ids"])
        order = np.argsort(ids.astype(np.min_scalar_type(self.kinds)), axis=None, kind="stable")  # short keys go by radix
        sorted_ids = ids.ravel()[order]
        first = np.flatnonzero(np.diff(sorted_ids, prepend=-1))
        if len(first):
            g["ids"][sorted_ids[first]] = np.add.reduceat(np.take(dx, order, axis=0), first, axis=0)
        return g

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.params.values()]).astype(np.float64)

    def load(self, flat: np.ndarray) -> Attention:
        at = 0
        for name, old in self.params.items():
            self.params[name] = flat[at:at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size
        return self


class Adam:
    def __init__(self, model: Attention, rate: float = 0.01):
        self.model, self.rate, self.steps = model, rate, 0
        self.first = np.zeros(sum(v.size for v in model.params.values()), np.float32)
        self.second = np.zeros_like(self.first)

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.steps += 1
        rate = self.rate / (1 + 0.01 * self.steps)
        g = np.concatenate([gradients[name].ravel() for name in self.model.params])
        self.first = 0.9 * self.first + 0.1 * g
        self.second = 0.99 * self.second + 0.01 * g * g
        m, v = self.first / (1 - 0.9 ** self.steps), self.second / (1 - 0.99 ** self.steps)
        moved, at = (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32), 0
        for value in self.model.params.values():
            value -= moved[at:at + value.size].reshape(value.shape)
            at += value.size


def windows(sequences: list[np.ndarray], begin: int, context: int = CONTEXT
            ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches (inputs, targets, wanted, sequence numbers of the windows) that want each id of
    each sequence once; a window repeats the last ``context`` ids of the one before it."""
    if not sequences:
        return
    lengths = np.array([len(s) for s in sequences])
    targets = np.concatenate(sequences)
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    inputs = np.empty_like(targets)
    inputs[1:] = targets[:-1]
    inputs[starts[lengths > 0]] = begin
    step = WINDOW - context
    count = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // step)), 0)
    owner = np.repeat(np.arange(len(sequences)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    first = number * step
    places = np.arange(WINDOW)
    for at in range(0, len(owner), _WINDOWS_AT_ONCE):
        part = slice(at, at + _WINDOWS_AT_ONCE)
        place = first[part, None] + places
        wanted = (place < lengths[owner[part], None]) & ((number[part, None] == 0) | (places >= context))
        index = np.minimum(starts[owner[part], None] + place, len(targets) - 1)
        yield inputs[index], targets[index], wanted, owner[part]
