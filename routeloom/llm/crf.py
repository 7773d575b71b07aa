"""Linear-chain conditional random fields over named binary features, trained and decoded in numpy batches."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np

EPOCHS, RATE, L2 = 60, 0.1, 2e-5
#: Padded places that one decoding batch holds.
PLACES = 1 << 20


@dataclass(frozen=True)
class Crf:
    """Weights of features, of steps between labels and of first labels; a feature unknown in training weighs nothing."""

    features: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray
    first: np.ndarray

    def emissions(self, sequence: Sequence[Iterable[str]]) -> np.ndarray:
        """The score of each label at each place of a sequence."""
        known = self.features
        ids = [[known[f] for f in place if f in known] for place in sequence]
        flat = self.weights[[i for place in ids for i in place]]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        sums = np.concatenate([np.zeros((1, flat.shape[1])), np.cumsum(flat, axis=0)])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]

    def decode(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest labels of each sequence (Viterbi); sequences of like length go through the steps together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(emissions)
        order = sorted((k for k in range(len(emissions)) if len(emissions[k])), key=lambda k: len(emissions[k]))
        while order:
            longest = len(emissions[order[-1]])
            batch = order[-max(1, PLACES // longest) :]
            del order[-len(batch) :]
            padded = np.zeros((longest, len(batch), len(self.first)))
            lengths = np.array([len(emissions[k]) for k in batch])
            for j, k in enumerate(batch):
                padded[: lengths[j], j] = emissions[k]
            best, back = self.first + padded[0], np.zeros((longest, len(batch), len(self.first)), np.int8)
            final = best.copy()
            for t in range(1, longest):
                paths = best[:, :, None] + self.steps
                back[t] = paths.argmax(1)
                best = paths.max(1) + padded[t]
                final = np.where((lengths > t)[:, None], best, final)
            label = final.argmax(1)
            labels = np.zeros((longest, len(batch)), np.int64)
            rows = np.arange(len(batch))
            for t in range(longest - 1, -1, -1):
                inside = lengths > t
                labels[t, inside] = label[inside]
                label = np.where(inside & (t > 0), back[t, rows, label], label)
            for j, k in enumerate(batch):
                out[k] = labels[: lengths[j], j]
        return out


def train(
    sequences: list[tuple[list[list[str]], list[int]]],
    n_labels: int,
    epochs: int = EPOCHS,
    rate: float = RATE,
    l2: float = L2,
) -> Crf:
    """Maximises the labels' mean log-likelihood, less an L2 penalty, by Adam on exact gradients.

    Forward and backward run over all sequences at once, longest first, so those that reach a step are the first rows
    of the one before. Their values are kept as probabilities that are normalised at every step, so a step is one
    product with the small matrix of label pairs.
    """
    sequences = sorted((s for s in sequences if s[1]), key=lambda s: -len(s[1]))
    features = {f: k for k, f in enumerate(sorted({f for places, _ in sequences for place in places for f in place}))}
    n, lengths = len(sequences), np.array([len(y) for _, y in sequences])
    width = [int((lengths > t).sum()) for t in range(lengths[0])]  # sequences that reach a step
    start = np.concatenate([[0], np.cumsum(width)])
    rows = [(t, j) for t, w in enumerate(width) for j in range(w)]
    gold = np.array([sequences[j][1][t] for t, j in rows])
    # places of equal features are summed before features are looked up
    number: dict[tuple[int, ...], int] = {}
    place = np.array(
        [number.setdefault(tuple(sorted({features[f] for f in sequences[j][0][t]})), len(number)) for t, j in rows]
    )
    held = np.concatenate([np.array(k, np.int64) for k in number])
    sizes = np.fromiter(map(len, number), np.int64, len(number))
    at, first_held = np.repeat(np.arange(len(number)), sizes), np.cumsum(sizes) - sizes
    by_feature = at[np.argsort(held, kind="stable")]
    first_at = np.searchsorted(np.sort(held), np.arange(len(features)))
    by_place, first_place = np.argsort(place, kind="stable"), np.searchsorted(np.sort(place), np.arange(len(number)))
    later = np.arange(width[0], len(rows))
    before = np.concatenate([start[t - 1] + np.arange(w) for t, w in enumerate(width) if t] or [later])
    one_hot = np.eye(n_labels)
    seen = one_hot[gold[before]].T @ one_hot[gold[later]]
    params = [np.zeros((len(features), n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for epoch in range(1, epochs + 1):
        weights, steps, first = params
        scores = np.add.reduceat(weights[held], first_held)[place]
        scores[:n] += first
        here, pair = np.exp(scores - scores.max(1, keepdims=True)), np.exp(steps - steps.max())
        ahead, behind = here.copy(), np.ones_like(here)
        ahead[:n] /= ahead[:n].sum(1, keepdims=True)
        for t in range(1, len(width)):
            now = ahead[start[t] : start[t + 1]]
            now *= ahead[start[t - 1] : start[t - 1] + width[t]] @ pair
            now /= now.sum(1, keepdims=True)
        for t in range(len(width) - 2, -1, -1):
            back = (here[start[t + 1] : start[t + 2]] * behind[start[t + 1] : start[t + 2]]) @ pair.T
            behind[start[t] : start[t] + width[t + 1]] = back / back.sum(1, keepdims=True)
        share = ahead * behind
        off = one_hot[gold] - share / share.sum(1, keepdims=True)
        come, go = ahead[before], here[later] * behind[later]
        expected = (come / ((come @ pair) * go).sum(1, keepdims=True)).T @ go * pair
        off_place = np.add.reduceat(off[by_place], first_place)
        slope = [np.add.reduceat(off_place[by_feature], first_at), seen - expected, off[:n].sum(0)]
        for k, (p, (m, v)) in enumerate(zip(params, moments)):
            g = slope[k] / n - l2 * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            params[k] = p + rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    return Crf(features, *params)
