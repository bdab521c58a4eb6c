"""Small linear models fitted with numpy: logistic regression and a two-label linear-chain CRF over hashed features."""

from __future__ import annotations

import numpy as np
import xxhash

_ids: dict[str, int] = {}


def feature_id(name: str, bits: int = 18) -> int:
    i = _ids.get(name)
    if i is None:
        if len(_ids) > 600_000:
            _ids.clear()
        i = _ids[name] = xxhash.xxh3_64_intdigest(name) & ((1 << bits) - 1)
    return i


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


class _Sparse:
    """Rows of weighted features: sums by row and by feature without a pass over the features nobody has."""

    def __init__(self, index: np.ndarray, value: np.ndarray | None, offsets: np.ndarray):
        self.used, column = np.unique(index, return_inverse=True)
        self.column, self.value = column.astype(np.intp), value
        self.filled = np.flatnonzero(np.diff(offsets))
        self.starts, self.rows = offsets[:-1][self.filled], len(offsets) - 1
        order = np.argsort(column, kind="stable")
        self.row_by_column = np.repeat(np.arange(self.rows), np.diff(offsets))[order]
        self.value_by_column = None if value is None else value[order]
        self.column_starts = np.searchsorted(column[order], np.arange(len(self.used)))
        self.room = np.empty(len(index))  # fresh memory for every sum would cost more than the sums

    def _sums(self, w: np.ndarray, at: np.ndarray, value: np.ndarray | None, starts: np.ndarray) -> np.ndarray:
        x = np.take(w, at, out=self.room, mode="clip")
        if value is not None:
            x *= value
        return np.add.reduceat(x, starts)

    def by_row(self, w: np.ndarray) -> np.ndarray:
        """Sum of the weights of each row; ``w`` goes by used feature."""
        out = np.zeros(self.rows)
        if len(self.filled):
            out[self.filled] = self._sums(w, self.column, self.value, self.starts)
        return out

    def by_feature(self, g: np.ndarray) -> np.ndarray:
        return self._sums(g, self.row_by_column, self.value_by_column, self.column_starts) if len(self.used) else np.zeros(0)


def fit_logistic(index: np.ndarray, value: np.ndarray, offsets: np.ndarray, y: np.ndarray, bits: int = 18, l2: float = 1e-4, rounds: int = 150, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularized logistic regression; rows are slices of (index, value); classes weigh the same."""
    w = np.zeros(1 << bits)
    if not len(y):
        return w, 0.0
    x = _Sparse(index, value, offsets)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    both, opt = np.zeros(len(x.used) + 1), Adam(len(x.used) + 1, rate)
    for _ in range(rounds):
        z = x.by_row(both[:-1]) + both[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        opt.step(both, np.concatenate((x.by_feature(g) + l2 * both[:-1], [g.sum()])))
    w[x.used] = both[:-1]
    return w, float(both[-1])


class _Side:
    """Chains side by side: all first items, then all second ones and so on, longer chains first. No padding, however long one of them is."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        first = (np.cumsum(lengths) - lengths)[order]
        #: chains that have a t-th item
        self.live = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), side="left")
        self.at = np.concatenate(([0], np.cumsum(self.live)))
        rank = np.concatenate([np.arange(k) for k in self.live]) if len(self.live) else np.zeros(0, np.int64)
        #: place in the flat order of the items of this order
        self.flat = first[rank] + np.repeat(np.arange(len(self.live)), self.live)
        #: the item before each item but the first ones
        self.before = (self.at[np.maximum(np.repeat(np.arange(len(self.live)), self.live) - 1, 0)] + rank)[self.live[0] if len(self.live) else 0 :]

    def steps(self, start: int = 1):
        return ((t, int(self.live[t]), int(self.at[t])) for t in range(start, len(self.live)))


class ChainCRF:
    """Two labels; an emission weight per hashed feature (for label 1 against 0), start weight and transitions."""

    def __init__(self, bits: int = 18):
        self.bits, self.w, self.start, self.trans = bits, np.zeros(1 << bits), 0.0, np.zeros((2, 2))

    def emissions(self, index: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(self.w[index])))
        return total[offsets[1:]] - total[offsets[:-1]]

    def fit(self, index, offsets, lengths, y, l2: float = 2e-6, rounds: int = 120, rate: float = 0.1) -> ChainCRF:
        """``index``/``offsets``: features of all items in order; ``lengths``: items of each chain; ``y``: labels of the items."""
        if not len(lengths):
            return self
        x, side = _Sparse(index, None, offsets), _Side(lengths)
        n = len(x.used)
        params, opt = np.zeros(n + 5), Adam(n + 5, rate)
        Y = y[side.flat].astype(int)
        total, k0 = len(y), int(side.live[0])
        seen = np.bincount(2 * Y[side.before] + Y[k0:], minlength=4)
        p, q = np.empty(total), np.empty(total)
        for _ in range(rounds):
            start, trans = params[n], params[n + 1 :].reshape(2, 2)
            E = np.exp(np.clip(x.by_row(params[:n]), -30, 30))[side.flat]
            T = np.exp(trans)
            # shares of label 1: forward in p, backward in q
            one = E[:k0] * np.exp(start)
            p[:k0] = one / (1 + one)
            for t, k, at in side.steps():
                b = p[at - int(side.live[t - 1]) :][:k]
                one = (T[0, 1] + (T[1, 1] - T[0, 1]) * b) * E[at : at + k]
                p[at : at + k] = one / (one + T[0, 0] + (T[1, 0] - T[0, 0]) * b)
            q[:] = 0.5
            for t, k, at in reversed(list(side.steps())):
                b = q[at : at + k]
                r0, r1 = 1 - b, E[at : at + k] * b
                v0, v1 = T[0, 0] * r0 + T[0, 1] * r1, T[1, 0] * r0 + T[1, 1] * r1
                q[at - int(side.live[t - 1]) :][:k] = v1 / (v0 + v1)
            p1 = p * q / (p * q + (1 - p) * (1 - q))
            a1, b0, b1 = p[side.before], 1 - q[k0:], E[k0:] * q[k0:]
            joint = np.stack(((1 - a1) * T[0, 0] * b0, (1 - a1) * T[0, 1] * b1, a1 * T[1, 0] * b0, a1 * T[1, 1] * b1))
            pair = (joint / joint.sum(axis=0)).sum(axis=1)
            d = p1 - Y
            by_item = np.empty(total)
            by_item[side.flat] = d
            grad = np.empty_like(params)
            grad[:n] = x.by_feature(by_item) / total + l2 * params[:n]
            grad[n] = d[:k0].sum() / total
            grad[n + 1 :] = (pair - seen) / total
            opt.step(params, grad)
        self.w = np.zeros(1 << self.bits)
        self.w[x.used] = params[:n]
        self.start, self.trans = float(params[n]), params[n + 1 :].reshape(2, 2).copy()
        return self

    def viterbi(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of all items; all chains are decoded side by side."""
        out = np.zeros(len(emissions), np.int8)
        if not len(emissions):
            return out
        side = _Side(lengths)
        e, tr = emissions[side.flat], self.trans
        k0 = int(side.live[0])
        s0, s1 = np.zeros(k0), e[:k0] + self.start
        came0, came1 = np.zeros(len(e), bool), np.zeros(len(e), bool)
        for _, k, at in side.steps():
            a, b = s0[:k].copy(), s1[:k].copy()
            stay, go = a + tr[0, 0], b + tr[1, 0]
            came0[at : at + k] = go > stay
            s0[:k] = np.maximum(stay, go)
            stay, go = a + tr[0, 1], b + tr[1, 1]
            came1[at : at + k] = go > stay
            s1[:k] = np.maximum(stay, go) + e[at : at + k]
        label = s1 > s0
        best = np.zeros(len(e), bool)
        for _, k, at in reversed(list(side.steps())):
            now = label[:k].copy()
            best[at : at + k] = now
            label[:k] = np.where(now, came1[at : at + k], came0[at : at + k])
        best[:k0] = label
        out[side.flat] = best
        return out
