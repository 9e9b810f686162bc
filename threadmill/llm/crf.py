"""A linear-chain conditional random field over token features, in numpy.

Training maximises the conditional likelihood (forward-backward, Adam);
decoding is Viterbi over whole batches of padded sequences.  A token's features
depend on its own string only and are looked at from the places around it, so
what a token adds to each place is computed once per distinct string.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

AROUND = range(-5, 6)


class Crf:
    def __init__(self, labels: Sequence[str], features: dict[str, int], of: Callable[[str], list[str]], n_flags: int):
        self.labels, self.features, self.of = list(labels), features, of
        n = len(self.labels)
        self.w = np.zeros((len(features), len(AROUND), n), np.float32)
        self.flag = np.zeros((n_flags, n), np.float32)
        self.step = np.zeros((n, n), np.float32)
        self.first = np.zeros(n, np.float32)

    def ids(self, key: str) -> list[int]:
        return [self.features[f] for f in self.of(key) if f in self.features]

    def reach(self, key: str) -> np.ndarray:
        """What a token adds to the places around it: (place, label)."""
        i = self.ids(key)
        return self.w[i].sum(axis=0) if i else np.zeros(self.w.shape[1:], np.float32)

    def emissions(self, table: np.ndarray, ids: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """(sequence, place, label) from token numbers (-1: none) and flags (0: none)."""
        b, t = ids.shape
        e = np.zeros((b, t, len(self.labels)), np.float32)
        for k, o in enumerate(AROUND):
            lo, hi = max(0, -o), min(t, t - o)
            if lo < hi:
                src = ids[:, lo + o : hi + o]
                e[:, lo:hi] += np.where((src >= 0)[..., None], table[src, k], 0)
        for f in range(1, len(self.flag)):
            e[flags == f] += self.flag[f]
        return e

    def decode(self, e: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Best labels (sequence, place); places beyond a sequence's length are 0."""
        b, t, n = e.shape
        score = self.first + e[:, 0]
        back = np.zeros((b, t, n), np.int8)
        for i in range(1, t):
            s = score[:, :, None] + self.step
            back[:, i] = s.argmax(axis=1)
            new = s.max(axis=1) + e[:, i]
            score = np.where((i < length)[:, None], new, score)
        out = np.zeros((b, t), np.int8)
        last = score.argmax(axis=1)
        for i in range(t - 1, -1, -1):
            inside = i < length
            out[inside, i] = last[inside]
            if i:
                last = np.where(inside, back[np.arange(b), i, last], last)
        return out

    def train(self, keys: list[list[str]], flags: list[list[int]], gold: list[list[int]], epochs: int = 6, batch: int = 64, rate: float = 0.04, l2: float = 1e-4, seed: int = 7) -> None:
        types = {k: i for i, k in enumerate(sorted({k for s in keys for k in s}))}
        held = [np.array(self.ids(k), np.int64) for k in types]
        n = len(self.labels)
        params = [self.w, self.flag, self.step, self.first]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        order, rng, at = np.argsort([len(k) for k in keys], kind="stable"), np.random.default_rng(seed), 0
        chunks = [order[i : i + batch] for i in range(0, len(order), batch)]
        steps = epochs * len(chunks)
        for _ in range(epochs):
            for c in rng.permutation(len(chunks)):
                rows = chunks[c]
                length = np.array([len(keys[r]) for r in rows])
                t = int(length.max())
                ids, fl, y = np.full((len(rows), t), -1), np.zeros((len(rows), t), int), np.zeros((len(rows), t), int)
                for j, r in enumerate(rows):
                    ids[j, : length[j]], fl[j, : length[j]], y[j, : length[j]] = [types[k] for k in keys[r]], flags[r], gold[r]
                used, local = np.unique(ids[ids >= 0], return_inverse=True)
                small = np.full_like(ids, -1)
                small[ids >= 0] = local
                # Only the features of this batch's tokens: a small dense incidence.
                some, place = np.unique(np.concatenate([held[i] for i in used]), return_inverse=True)
                inc = np.zeros((len(used), len(some)), np.float32)
                inc[np.repeat(np.arange(len(used)), [len(held[i]) for i in used]), place] = 1
                table = (inc @ self.w[some].reshape(len(some), -1)).reshape(len(used), len(AROUND), n)
                e = self.emissions(table, small, fl)
                p, pair = self._marginals(e, length)
                inside = np.arange(t)[None, :] < length[:, None]
                d = np.eye(n, dtype=np.float32)[y] - p
                d[~inside] = 0
                g_table = np.zeros_like(table)
                for k, o in enumerate(AROUND):
                    lo, hi = max(0, -o), min(t, t - o)
                    if lo < hi:
                        src = small[:, lo + o : hi + o]
                        ok = src >= 0
                        np.add.at(g_table[:, k], src[ok], d[:, lo:hi][ok])
                g_w = np.zeros_like(self.w)
                g_w[some] = (inc.T @ g_table.reshape(len(used), -1)).reshape(len(some), *self.w.shape[1:])
                g_flag = np.zeros_like(self.flag)
                np.add.at(g_flag, fl[inside], d[inside])
                g_flag[0] = 0
                g_step = -pair
                both = inside[:, 1:]
                np.add.at(g_step, (y[:, :-1][both], y[:, 1:][both]), 1)
                g_first = d[:, 0].sum(axis=0)
                at += 1
                for q, g, mm, vv in zip(params, (g_w, g_flag, g_step, g_first), m, v):
                    g = g / len(rows) - l2 * q
                    mm += 0.1 * (g - mm)
                    vv += 0.01 * (g * g - vv)
                    q += rate * (1.02 - at / steps) * (mm / (1 - 0.9**at)) / (np.sqrt(vv / (1 - 0.99**at)) + 1e-6)

    def _marginals(self, e: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b, t, n = e.shape
        top = lambda x, axis: (mx := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - mx).sum(axis=axis))
        a, z = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = self.first + e[:, 0]
        for i in range(1, t):
            new = top(a[:, i - 1][:, :, None] + self.step, 1) + e[:, i]
            a[:, i] = np.where((i < length)[:, None], new, a[:, i - 1])
        total = top(a[:, -1], 1)
        pair = np.zeros((n, n), np.float32)
        for i in range(t - 2, -1, -1):
            go = self.step[None] + (e[:, i + 1] + z[:, i + 1])[:, None, :]
            inside = (i + 1 < length)[:, None]
            z[:, i] = np.where(inside, top(go, 2), 0)
            pair += (np.exp(a[:, i][:, :, None] + go - total[:, None, None]) * inside[:, :, None]).sum(axis=0)
        return np.exp(a + z - total[:, None, None]), pair
