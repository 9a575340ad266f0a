"""A linear-chain conditional random field with two labels over sparse binary features, in numpy.

Training maximises the likelihood of labelled sequences with a Gaussian prior by Adam on the whole set; expectations come
from forward and backward passes over all sequences at once. Decoding is by Viterbi.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Field:
    """Weights of features towards label 1, and of neighbours, first and last labels."""

    weights: dict[str, float]
    steps: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def decode(self, sequence: list[list[str]]) -> list[int]:
        """The most likely labels; of equal ones the smaller label."""
        if not sequence:
            return []
        (s00, s01), (s10, s11) = self.steps.tolist()
        weight = self.weights.get
        back = []
        a, b = self.first.tolist()
        for place, features in enumerate(sequence):
            if place:
                to_zero, to_one = b + s10 > a + s00, b + s11 > a + s01
                a, b = (b + s10 if to_zero else a + s00), (b + s11 if to_one else a + s01)
                back.append((to_zero, to_one))
            b += sum(weight(f, 0.0) for f in features)
        label = int(b + self.last[1] > a + self.last[0])
        out = [label]
        for choice in reversed(back):
            label = int(choice[label])
            out.append(label)
        return out[::-1]


def fitted(sequences: list[list[list[str]]], labels: list[list[int]], rounds: int = 200, rate: float = 0.05, prior: float = 0.02, least: int = 3) -> Field:
    """Fit to labelled sequences; features seen fewer than ``least`` times are left out."""
    pairs = sorted(((s, y) for s, y in zip(sequences, labels, strict=True) if s), key=lambda p: -len(p[0]))
    seen: dict[str, int] = {}
    for s, _ in pairs:
        for features in s:
            for f in features:
                seen[f] = seen.get(f, 0) + 1
    number = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    count, longest, size = len(pairs), len(pairs[0][0]), len(number)
    where, owners = [], []
    truth = np.zeros((longest, count), dtype=np.int64)
    there = np.zeros((longest, count), dtype=bool)
    for k, (s, y) in enumerate(pairs):
        there[: len(s), k] = True
        truth[: len(s), k] = y
        for t, features in enumerate(s):
            ids = [number[f] for f in features if f in number]
            where += ids
            owners += [t * count + k] * len(ids)
    where, owners = np.array(where, dtype=np.int64), np.array(owners, dtype=np.int64)
    ends = np.array([len(s) - 1 for s, _ in pairs])
    columns = np.arange(count)
    wanted = np.zeros((2, 2))
    inner = there[1:]
    np.add.at(wanted, (truth[:-1][inner], truth[1:][inner]), 1)
    wanted_first = np.bincount(truth[0], minlength=2)
    wanted_last = np.bincount(truth[ends, columns], minlength=2)
    # All parameters in one vector: features, steps, first, last.
    x = np.zeros(size + 8)
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        w, steps, first, last = x[:size], x[size : size + 4].reshape(2, 2), x[size + 4 : size + 6], x[size + 6 :]
        gain = np.bincount(owners, w[where], minlength=longest * count).reshape(longest, count)
        ahead = np.empty((longest, 2, count))
        ahead[0, 0], ahead[0, 1] = first[0], first[1] + gain[0]
        for t in range(1, longest):
            for y in (0, 1):
                ahead[t, y] = np.logaddexp(ahead[t - 1, 0] + steps[0, y], ahead[t - 1, 1] + steps[1, y]) + (gain[t] if y else 0)
        behind = np.zeros((longest, 2, count))
        for t in range(longest - 1, -1, -1):
            at_end = ends == t
            for y in (0, 1):
                if t + 1 < longest:
                    behind[t, y] = np.logaddexp(steps[y, 0] + behind[t + 1, 0], steps[y, 1] + gain[t + 1] + behind[t + 1, 1])
                behind[t, y][at_end] = last[y]
        total = np.logaddexp(ahead[0, 0] + behind[0, 0], ahead[0, 1] + behind[0, 1])
        one = np.where(there, np.exp(np.minimum(ahead[:, 1] + behind[:, 1] - total, 0)), 0)
        gradient = np.empty_like(x)
        gradient[:size] = np.bincount(where, (np.where(there, truth, 0) - one).ravel()[owners], minlength=size)
        expected = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                chance = ahead[:-1, a] + steps[a, b] + (gain[1:] if b else 0) + behind[1:, b] - total
                expected[a, b] = np.exp(np.minimum(chance[inner], 0)).sum()
        gradient[size : size + 4] = (wanted - expected).ravel()
        gradient[size + 4 : size + 6] = wanted_first - np.array([count - one[0].sum(), one[0].sum()])
        ones = one[ends, columns].sum()
        gradient[size + 6 :] = wanted_last - np.array([count - ones, ones])
        gradient = gradient / count - prior / count * x
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        x = x + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights = {f: float(x[i]) for f, i in number.items()}
    return Field(weights, x[size : size + 4].reshape(2, 2).copy(), x[size + 4 : size + 6].copy(), x[size + 6 :].copy())
