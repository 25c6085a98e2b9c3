"""Forward-backward over many label chains at once, for hidden Markov models and linear-chain random fields."""

from __future__ import annotations

import numpy as np


class Chains:
    """The layout of several chains, given by their lengths (all above zero), stepped together.

    Chains are put in order of falling length, and elements in order of step, so that step t is one slice of rows.
    """

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, dtype=np.int64)
        order = np.argsort(-self.lengths, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.order = order
        top = int(self.lengths.max(initial=0))
        # chains that are longer than t, for each t
        active = len(order) - np.searchsorted(np.sort(self.lengths), np.arange(top), side="right")
        self.bounds = np.concatenate(([0], np.cumsum(active)))
        step = np.arange(int(self.lengths.sum())) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.place = self.bounds[step] + np.repeat(rank, self.lengths)  # where the elements of the chains go

    def forward(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward probabilities and scales, both by step; emit: rows by step, one column per label.

        start: the weights of the labels at the first step, for all chains or a row for each.
        """
        start = start[self.order] if start.ndim == 2 else start
        alpha, scale, b = np.empty_like(emit), np.empty(len(emit)), self.bounds
        for t in range(len(b) - 1):
            n = b[t + 1] - b[t]
            now = (start if t == 0 else alpha[b[t - 1] : b[t - 1] + n] @ move) * emit[b[t] : b[t + 1]]
            s = now.sum(axis=1)
            scale[b[t] : b[t + 1]] = s
            np.divide(now, s[:, None], out=alpha[b[t] : b[t + 1]])
        return alpha, scale

    def log_likelihood(self, scale: np.ndarray) -> np.ndarray:
        """Natural log of the product of scales of each chain."""
        ends = np.cumsum(self.lengths)
        total = np.concatenate(([0.0], np.cumsum(np.log(scale)[self.place])))
        return total[ends] - total[ends - self.lengths]

    def posteriors(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray, pairs: bool = True, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """(label posteriors by step, expected moves between labels, scales).

        end: a row for each chain with the weights of its last labels, for what follows it; posteriors are then in proportion
        and not divided by their sum.
        """
        end = np.ones((len(self.lengths), emit.shape[1])) if end is None else end[self.order]
        alpha, scale = self.forward(emit, move, start)
        b = self.bounds
        back = np.ones_like(emit)  # emission times what follows, over the scale
        beta = end[: b[-1] - b[-2] if len(b) > 1 else 0].copy()
        moves = np.zeros_like(move)
        for t in range(len(b) - 2, -1, -1):
            now = slice(b[t], b[t + 1])
            back[now] = emit[now] * beta / scale[now][:, None]
            alpha[now] *= beta
            if t:
                n = b[t + 1] - b[t]
                before = end[: b[t] - b[t - 1]].copy()
                before[:n] = back[now] @ move.T
                beta = before
                if pairs:
                    moves += alpha[b[t - 1] : b[t - 1] + n].T @ back[now]
        return alpha, moves * move if pairs else None, scale

    def transfers(self, emit: np.ndarray, move: np.ndarray) -> np.ndarray:
        """(chains, labels, labels): the weight of each last label after each label before the chain, largest 1 in a chain."""
        n = emit.shape[1]
        out = np.empty((len(self.lengths), n, n))
        logs = np.empty((len(self.lengths), n))
        last = self.place[np.cumsum(self.lengths) - 1]
        for i in range(n):
            alpha, scale = self.forward(emit, move, move[i])
            out[:, i] = alpha[last]
            logs[:, i] = self.log_likelihood(scale)
        return out * np.exp(logs - logs.max(axis=1, keepdims=True))[:, :, None]
