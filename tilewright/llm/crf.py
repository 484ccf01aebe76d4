"""A linear-chain conditional random field in numpy: training by gradient, decoding by Viterbi."""

from __future__ import annotations

import zlib

import numpy as np

#: Features are hashed to this many weights for each label.
SPACE = 1 << 13


def feature(name: str) -> int:
    return zlib.crc32(name.encode()) % SPACE


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(sequences: list[tuple[list[list[int]], list[int]]], labels: int, rounds: int = 80, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x labels) and transitions (from x to) that maximise the labels' likelihood.

    sequences: for each, the feature numbers of every place and the label of every place.
    """
    longest = max(len(y) for _, y in sequences)
    n = len(sequences)
    gold = np.zeros((n, longest), dtype=np.int64)
    mask = np.zeros((n, longest), dtype=bool)
    ids, at = [], []
    for s, (x, y) in enumerate(sequences):
        gold[s, : len(y)], mask[s, : len(y)] = y, True
        for t, own in enumerate(x):
            ids.extend(own)
            at.extend([s * longest + t] * len(own))
    ids, at = np.array(ids), np.array(at)
    w, trans = np.zeros((SPACE, labels)), np.zeros((labels, labels))
    seen_w, seen_t = np.full_like(w, 1e-6), np.full_like(trans, 1e-6)
    target = np.zeros((n, longest, labels))
    target[np.arange(n)[:, None], np.arange(longest)[None, :], gold] = 1
    target *= mask[..., None]
    both = mask[:, 1:] & mask[:, :-1]
    gold_t = np.bincount((gold[:, :-1] * labels + gold[:, 1:])[both], minlength=labels * labels).reshape(labels, labels)
    for _ in range(rounds):
        e = np.stack([np.bincount(at, weights=w[ids, k], minlength=n * longest) for k in range(labels)], axis=1).reshape(n, longest, labels)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            moved = log_sum(alpha[:, t - 1, :, None] + trans, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], moved, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            moved = log_sum(trans[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], moved, 0.0)
        z = log_sum(alpha[:, -1], 1)
        marginal = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        grad_e = (target - marginal).reshape(-1, labels)
        grad_w = np.stack([np.bincount(ids, weights=grad_e[at, k], minlength=SPACE) for k in range(labels)], axis=1) - decay * n * w
        pair = np.exp(alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
        grad_t = gold_t - pair.sum(axis=(0, 1)) - decay * n * trans
        seen_w += grad_w**2
        seen_t += grad_t**2
        w += rate * grad_w / np.sqrt(seen_w)
        trans += rate * grad_t / np.sqrt(seen_t)
    return w, trans


def viterbi(e: np.ndarray, trans: np.ndarray, before: int | None = None, after: int | None = None) -> np.ndarray:
    """The best labels for emissions (places x labels); before, after: known labels beside the sequence."""
    n, labels = e.shape
    back = np.zeros((n, labels), dtype=np.int64)
    score = e[0] + (trans[before] if before is not None else 0)
    for t in range(1, n):
        moved = score[:, None] + trans
        back[t] = moved.argmax(axis=0)
        score = moved.max(axis=0) + e[t]
    if after is not None:
        score = score + trans[:, after]
    out = np.empty(n, dtype=np.int64)
    out[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def margin(trans: np.ndarray, keep: int) -> float:
    """By so much at most can transitions favour another label over ``keep`` at one place; where emissions
    lead by more, the best path has ``keep`` there whatever stands beside it."""
    into = (trans - trans[:, [keep]]).max()
    out = (trans - trans[[keep], :]).max()
    return float(max(into, 0) + max(out, 0))


def viterbi_sparse(e: np.ndarray, trans: np.ndarray, keep: int, lead: float) -> list[tuple[int, np.ndarray]]:
    """Exact Viterbi decoding where nearly all places are ``keep``: (start, labels) of the stretches whose
    labels aren't settled by their emissions alone; everywhere else the best label is ``keep``."""
    others = np.delete(e, keep, axis=1).max(axis=1)
    open_ = np.flatnonzero(e[:, keep] - others <= lead)
    if len(open_) == 0:
        return []
    out = []
    for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
        s, t = int(part[0]), int(part[-1]) + 1
        out.append((s, viterbi(e[s:t], trans, keep if s else None, keep if t < len(e) else None)))
    return out
