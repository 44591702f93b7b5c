"""A linear-chain conditional random field in numpy: training by gradient, decoding by Viterbi, both over batches of chains."""

from __future__ import annotations

import numpy as np


def _pad(chains: list[list[np.ndarray]], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores[chain, place, label], lengths): the sum of the weights of each place's features."""
    sizes = np.array([len(c) for c in chains])
    out = np.zeros((len(chains), int(sizes.max(initial=0)), weights.shape[1]))
    flat = [x for c in chains for x in c]
    if flat:
        counts = np.array([len(x) for x in flat])
        sums = np.add.reduceat(weights[np.concatenate(flat)], np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0)
        out[np.arange(out.shape[1]) < sizes[:, None]] = sums
    return out, sizes


def viterbi(chains: list[list[np.ndarray]], weights: np.ndarray, moves: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """The likeliest labels of each chain, given as the feature numbers (at least one) of its places."""
    scores, sizes = _pad(chains, weights)
    n, longest, labels = scores.shape
    if not n or not longest:
        return [np.zeros(0, np.int64) for _ in chains]
    best = np.where(sizes[:, None] > 0, start + scores[:, 0], 0)
    came = np.zeros((longest, n, labels), np.int8)
    for t in range(1, longest):
        ways = best[:, :, None] + moves
        came[t] = ways.argmax(axis=1)
        best = np.where((t < sizes)[:, None], ways.max(axis=1) + scores[:, t], best)
    label, out = best.argmax(axis=1), np.zeros((n, longest), np.int64)
    for t in range(longest - 1, -1, -1):
        out[:, t] = label
        label = np.where(t < sizes, came[t, np.arange(n), label], label) if t else label
    return [out[i, : sizes[i]] for i in range(n)]


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def train(chains: list[list[np.ndarray]], truth: list[list[int]], n_features: int, n_labels: int, rounds: int = 80, rate: float = 0.1, ridge: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, moves, start) that maximise the penalised likelihood of the labels; Adam with forward-backward sums."""
    shapes = [(n_features, n_labels), (n_labels, n_labels), (1, n_labels)]
    params = [np.zeros(s) for s in shapes]
    first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    sizes = np.array([len(c) for c in chains])
    longest = int(sizes.max())
    inside = np.arange(longest) < sizes[:, None]
    gold = np.zeros((len(chains), longest), np.int64)
    gold[inside] = np.concatenate([np.asarray(x) for x in truth])
    flat = [x for c in chains for x in c]
    counts = np.array([len(x) for x in flat])
    every, at = np.concatenate(flat), np.repeat(np.arange(len(flat)), counts)
    for step in range(1, rounds + 1):
        weights, moves, start = params
        scores, _ = _pad(chains, weights)
        ahead, back = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = start + scores[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(inside[:, t, None], _sum_exp(ahead[:, t - 1, :, None] + moves, 1) + scores[:, t], ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            back[:, t] = np.where(inside[:, t + 1, None], _sum_exp(moves + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2), 0)
        total = _sum_exp(ahead[:, -1], 1)[:, None]
        chance = np.exp(ahead + back - total[:, :, None])
        d_scores = (np.eye(n_labels)[gold] - chance)[inside]
        d_moves = np.zeros_like(moves)
        for t in range(1, longest):
            go = inside[:, t]
            pair = np.exp(ahead[go, t - 1, :, None] + moves + (scores[go, t] + back[go, t])[:, None, :] - total[go][:, :, None])
            d_moves -= pair.sum(axis=0)
            np.add.at(d_moves, (gold[go, t - 1], gold[go, t]), 1)
        d_weights = np.zeros_like(weights)
        np.add.at(d_weights, every, d_scores[at])
        d_start = (np.eye(n_labels)[gold[:, 0]] - chance[:, 0]).sum(axis=0, keepdims=True)
        for i, grad in enumerate((d_weights, d_moves, d_start)):
            grad = grad / len(chains) - ridge * params[i] / len(chains)
            first[i], second[i] = 0.9 * first[i] + 0.1 * grad, 0.99 * second[i] + 0.01 * grad**2
            params[i] = params[i] + rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-9)
    return params[0], params[1], params[2][0]
