"""Cheapest partners among all clusters: an exact search that leaves out only what cannot be cheaper.

Joining clusters costs ``w1 w2 / (w1 + w2)`` times their squared Gower dissimilarity, which grows with both weights. So the
distance to the box around some clusters, with the least of their weights, is a lower bound for each of them. Clusters are laid
out in small leaves that halve the widest feature; a leaf is skipped for a cluster only if that bound is above the cost of a
partner the cluster already has. Of partners at equal cost the one with the smallest number is taken.
"""

from __future__ import annotations

import numpy as np

LEAF = 32
NEAR = 8
CELLS = 1 << 21
NOBODY = np.iinfo(np.int64).max
SLACK = 1 - 1e-9  # bounds are sums in another order than costs


def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * b / (a + b)


def leaf_starts(features: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, and the places in it where leaves of at most ``leaf`` rows begin."""
    order = np.arange(features.shape[1])
    starts, todo = [], [(0, len(order))]
    while todo:
        begin, end = todo.pop()
        if end - begin <= leaf:
            starts.append(begin)
            continue
        rows = order[begin:end]
        x = features[:, rows]
        half = (end - begin) // 2
        order[begin:end] = rows[np.argpartition(x[np.argmax(np.ptp(x, axis=1))], half)]
        todo += [(begin, begin + half), (begin + half, end)]
    return order, np.sort(starts)


class Leaves:
    """Clusters by (leaf, slot); empty slots are infinitely far. ``cost`` and ``partner`` are the cheapest so far."""

    def __init__(self, number: np.ndarray, weight: np.ndarray, features: np.ndarray, leaf: int = LEAF):
        order, starts = leaf_starts(features, leaf)
        sizes = np.diff(np.append(starts, len(order)))
        slot = np.arange(sizes.max())
        self.filled = slot < sizes[:, None]
        rows = order[np.minimum(starts[:, None] + slot, len(order) - 1)]
        self.rows = rows
        self.number = np.where(self.filled, number[rows], NOBODY)
        self.w = np.where(self.filled, weight[rows], 1.0)
        self.f = np.where(self.filled, features[:, rows], np.inf)
        self.light = np.where(self.filled, weight[rows], np.inf).min(axis=1)
        self.low = self.f.min(axis=2)
        self.high = np.where(self.filled, features[:, rows], -np.inf).max(axis=2)
        self.cost = np.where(self.filled, np.inf, -np.inf)  # nothing is looked up for an empty slot
        self.partner = np.full(rows.shape, NOBODY)

    def start(self, cost: np.ndarray, partner: np.ndarray) -> None:
        """Partners known before, by row of the input."""
        self.cost[self.filled] = cost[self.rows[self.filled]]
        self.partner[self.filled] = partner[self.rows[self.filled]]

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """(cost, partner) by row of the input."""
        cost, partner = np.empty(self.filled.sum()), np.empty(self.filled.sum(), dtype=np.int64)
        cost[self.rows[self.filled]] = self.cost[self.filled]
        partner[self.rows[self.filled]] = self.partner[self.filled]
        return cost, partner


def box_bound(weight: np.ndarray, low: np.ndarray, high: np.ndarray, light: np.ndarray, to_low: np.ndarray, to_high: np.ndarray) -> np.ndarray:
    """No cluster of at least ``light`` in the second box costs less to any of at least ``weight`` in the first; features come first."""
    gap = sum(np.maximum(np.maximum(a - d, c - b), 0.0) for a, b, c, d in zip(low, high, to_low, to_high)) / float(len(low))
    return share(weight, light) * (gap * gap) * SLACK


def look_up(ask: Leaves, to: Leaves) -> None:
    """Give every cluster in ``ask`` its cheapest partner of those it has and all in ``to``, itself left out."""
    step = max(1, CELLS // len(to.light))
    middle = [(np.add(a.low, a.high) / 2)[:, :, None] for a in (ask, to)]
    for begin in range(0, len(ask.light), step):
        s = slice(begin, begin + step)
        bound = box_bound(ask.light[s, None], ask.low[:, s, None], ask.high[:, s, None], to.light, to.low[:, None], to.high[:, None])
        away = sum(np.abs(x[s] - y.T) for x, y in zip(*middle))
        near = np.argpartition(away, NEAR, axis=1)[:, :NEAR] if away.shape[1] > NEAR else np.tile(np.arange(away.shape[1]), (len(away), 1))
        leaf = np.arange(len(away))
        for t in near.T:
            compare(ask, to, leaf + begin, t)
            bound[leaf, t] = np.inf
        q, t = np.nonzero(bound <= ask.cost[s].max(axis=1)[:, None])
        compare(ask, to, q + begin, t)


def compare(ask: Leaves, to: Leaves, q: np.ndarray, t: np.ndarray) -> None:
    """Pairs of leaves: each cluster of ``q`` against those leaves of ``t`` that its own bound does not rule out."""
    step = max(1, CELLS // (2 * ask.w.shape[1] * to.w.shape[1]))
    cost, partner = ask.cost.reshape(-1), ask.partner.reshape(-1)
    for begin in range(0, len(q), step):
        a, b = q[begin:begin + step], t[begin:begin + step]
        x = ask.f[:, a]
        bound = box_bound(ask.w[a], x, x, to.light[b, None], to.low[:, b, None], to.high[:, b, None])
        i, slot = np.nonzero(bound <= ask.cost[a])
        a, b = a[i], b[i]
        gower = np.zeros((len(a), to.w.shape[1]))
        for x, y in zip(ask.f, to.f):
            gower += np.abs(x[a, slot][:, None] - y[b])
        gower = gower / float(len(ask.f))
        price = share(ask.w[a, slot][:, None], to.w[b]) * (gower * gower)
        number = to.number[b]
        price[number == ask.number[a, slot][:, None]] = np.inf
        least = price.min(axis=1)
        who = np.where(price == least[:, None], number, NOBODY).min(axis=1)
        at = a * ask.w.shape[1] + slot
        before = cost[at]
        np.minimum.at(cost, at, least)
        partner[at[cost[at] < before]] = NOBODY
        tied = least == cost[at]
        np.minimum.at(partner, at[tied], who[tied])


def cheapest_partners(number: np.ndarray, weight: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost, number of the partner) of each of at least two clusters."""
    leaves = Leaves(number, weight, features)
    look_up(leaves, leaves)
    return leaves.found()
