"""Steps of the open-set loop for a few rows: in one place, without jobs.

A block of a stream is small, and a job costs more than its work. Each step has a form for tables of any size beside it, which it is held
against: `clusters.new_classes`, `models.fit_learners`, `increments.fit_guards`, `increments.subsample`, `increments.spread_by_loss`,
`lifecycle.batch_reason`. Who calls these bounds the rows.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .increments import Guard
from .lifecycle import Gate
from .models import BACKENDS, Forest, matrix, tail_threshold

#: Pairs of cells that are looked at in one place; beyond that the form for tables of any size has to do it.
MOST_PAIRS = 20_000_000
_CHUNK = 2_000_000
#: The cluster of a row that has none.
NOISE = np.iinfo(np.int64).max


def scales(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each column; a constant one has the deviation 1."""
    same = x.max(axis=0) == x.min(axis=0)
    mean, std = np.where(same, x[0], x.mean(axis=0)), np.where(same, 1.0, x.std(axis=0))
    std[std == 0] = 1
    return mean, std


# density clusters


def _distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, and of each row the place of its own."""
    order = np.lexsort(a.T[::-1])
    new = np.r_[True, (a[order][1:] != a[order][:-1]).any(axis=1)]
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    return a[order][new], place


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... n of them, for each start."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start, n)


def _members(a: np.ndarray, b: np.ndarray, start: np.ndarray, n: np.ndarray, of: tuple | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a member of a[k] and a member of b[k], in parts; members of c are start[c], ... n[c] of them. of: start and n of b's."""
    b_start, b_n = of or (start, n)
    size = n[a] * b_n[b]
    part = np.cumsum(size) // _CHUNK
    for low, high in zip(*(np.searchsorted(part, np.unique(part), s) for s in ("left", "right")), strict=True):
        p, q = a[low:high], b[low:high]
        left = _ranges(start[p], n[p])
        times = np.repeat(b_n[q], n[p])
        yield np.repeat(left, times), _ranges(np.repeat(b_start[q], n[p]), times)


def _near_cells(cell: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs of different cells that may hold spots within eps of each other, both ways; None if there are too many to look at."""
    reach = int(np.ceil(np.sqrt(d)))
    widest = np.argsort(-(cell.max(axis=0) - cell.min(axis=0)), kind="stable")[:3]
    coarse = cell[:, widest] // reach
    coarse = coarse - coarse.min(axis=0) + 1
    step = np.cumprod(np.r_[1, (coarse.max(axis=0) + 2)[:-1]].astype(float))
    if step[-1] * (coarse[:, -1].max() + 2) > 2**62:
        return None
    code = coarse @ step.astype(np.int64)
    order = np.argsort(code, kind="stable")
    codes, start, n = np.unique(code[order], return_index=True, return_counts=True)
    found_a, found_b, total = [], [], 0
    for offset in product((-1, 0, 1), repeat=len(widest)):
        to = codes + int(np.dot(offset, step.astype(np.int64)))
        at = np.minimum(np.searchsorted(codes, to), len(codes) - 1)
        have = np.flatnonzero(codes[at] == to)
        total += int((n[have] * n[at[have]]).sum())
        if total > MOST_PAIRS:
            return None
        for i, j in _members(have, at[have], start, n):
            p, q = order[i], order[j]
            gap = np.maximum(np.abs(cell[p] - cell[q]) - 1, 0)
            ok = (p != q) & ((gap * gap).sum(axis=1) <= d)
            found_a.append(p[ok])
            found_b.append(q[ok])
    return np.concatenate(found_a), np.concatenate(found_b)


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (places of roots) after the ends of all edges have come together: the smallest place of each component."""
    while len(a):
        p, q = label[a], label[b]
        open_ = p != q
        if not open_.any():
            break
        a, b, p, q = a[open_], b[open_], p[open_], q[open_]
        label = label.copy()
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    return label


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


def density_clusters(keys: np.ndarray, x: np.ndarray, eps: float, least: int) -> np.ndarray | None:
    """Of each row the smallest key of its cluster's core rows, or NOISE; what clusters.density_clusters() gives. x: features as they are;
    keys: distinct. None if there are too many near cells."""
    if not len(x):
        return np.empty(0, np.int64)
    mean, std = scales(x)
    spot_x, spot_of = _distinct((x - mean) / std + 0.0)
    w = np.bincount(spot_of)
    first = np.full(len(spot_x), NOISE)
    np.minimum.at(first, spot_of, keys)
    d, limit = x.shape[1], eps * eps
    if np.abs(spot_x).max() / eps > 2**40:
        return None
    cells, cell_of = _distinct(np.floor(spot_x / (eps / np.sqrt(d))).astype(np.int64))
    order = np.argsort(cell_of, kind="stable")  # spots of a cell stand together
    spot_x, w, first, cell_of, place = spot_x[order], w[order], first[order], cell_of[order], np.argsort(order)
    n = np.bincount(cell_of)
    start = np.cumsum(n) - n
    cell_w = np.bincount(cell_of, w).astype(np.int64)
    near = _near_cells(cells, d)
    if near is None:
        return None
    a, b = near

    weight = cell_w[cell_of].copy()
    sparse = cell_w[a] < least
    if int((n[a[sparse]] * n[b[sparse]]).sum()) > 50 * MOST_PAIRS:
        return None
    for i, j in _members(a[sparse], b[sparse], start, n):
        ok = _squared(spot_x[i], spot_x[j]) <= limit
        weight += np.bincount(i[ok], w[j[ok]], len(weight)).astype(np.int64)
    core = weight >= least

    # cells that belong together: outermost core spots first, then spot by spot where these leave it open
    core_x, core_cell = spot_x[core], cell_of[core]
    core_n = np.bincount(core_cell, minlength=len(cells))
    core_start = np.cumsum(core_n) - core_n
    label = np.arange(len(cells))
    both = (a < b) & (core_n[a] > 0) & (core_n[b] > 0)
    a2, b2 = a[both], b[both]
    if len(a2):
        tip = np.empty((len(cells), 2 * d), np.int64)
        for k in range(d):
            by = np.lexsort((core_x[:, k], core_cell))
            have = core_n > 0
            tip[have, 2 * k], tip[have, 2 * k + 1] = by[core_start[have]], by[core_start[have] + core_n[have] - 1]
        meets = np.zeros(len(a2), bool)
        for s, t in product(range(2 * d), repeat=2):
            meets |= _squared(core_x[tip[a2, s]], core_x[tip[b2, t]]) <= limit
        label = _joined(label, a2[meets], b2[meets])
        low, high = (np.stack([core_x[tip[:, 2 * k + e] * (core_n > 0), k] for k in range(d)], axis=1) for e in (0, 1))
        gap = np.maximum(np.maximum(low[a2] - high[b2], low[b2] - high[a2]), 0)
        open_ = np.flatnonzero(~meets & ((core_n[a2] > 2) | (core_n[b2] > 2)) & ((gap * gap).sum(axis=1) <= limit))
        for p, q in zip(a2[open_], b2[open_], strict=True):
            if label[p] == label[q]:
                continue
            u, v = (core_x[core_start[c] : core_start[c] + core_n[c]] for c in (p, q))
            if any((_squared(u[at : at + 256, None, :], v[None, :, :]) <= limit).any() for at in range(0, len(u), 256)):
                r, s = sorted((label[p], label[q]))
                label[label == s] = r
    smallest = np.full(len(cells), NOISE)
    np.minimum.at(smallest, label[core_cell], first[core])
    taken = np.full(len(spot_x), NOISE)
    taken[core] = smallest[label[core_cell]]

    # the others go to the cluster of smallest key with a core spot within eps; core spots of their own cell all are
    border = np.flatnonzero(~core)
    own = core_n[cell_of[border]] > 0
    taken[border[own]] = smallest[label[cell_of[border[own]]]]
    border_n = np.bincount(cell_of[border], minlength=len(cells))
    border_start = np.cumsum(border_n) - border_n
    reachable = (border_n[a] > 0) & (core_n[b] > 0)
    for i, j in _members(a[reachable], b[reachable], border_start, border_n, (core_start, core_n)):
        i = border[i]
        ok = _squared(spot_x[i], core_x[j]) <= limit
        np.minimum.at(taken, i[ok], smallest[label[core_cell[j[ok]]]])
    return taken[place][spot_of]


def new_classes(rows: pd.DataFrame, features: list[str], eps: float, least: int, least_class: int) -> np.ndarray | None:
    """Of each row (row_index, features) the number of its new class, -1 without one; as clusters.new_classes()."""
    found = density_clusters(rows["row_index"].to_numpy(), matrix(rows, features), eps, least)
    if found is None:
        return None
    names, place, n = np.unique(found, return_inverse=True, return_counts=True)
    large = (n >= least_class) & (names != NOISE)
    return np.where(large, np.cumsum(large) - 1, -1)[place]


# samples and models


def sample(keys: np.ndarray, most: int, seed: int) -> np.ndarray:
    """Places of `most` rows at most: those with the smallest md5 of seed and key; as cleaning.sample_per_group()."""
    if len(keys) <= most:
        return np.arange(len(keys))
    rank = np.array([hashlib.md5(f"{seed}|{k}".encode()).digest() for k in keys.tolist()], "S16")
    # fixed-width bytes drop zeros at their end, which leaves their order
    return np.sort(np.lexsort((keys, rank))[:most])


def even(n: int, k: int) -> np.ndarray:
    """k even places of n, the first and the last included."""
    if n <= k:
        return np.arange(n)
    return np.arange(1) if k <= 1 else np.unique(np.arange(k) * (n - 1) // (k - 1))


def spread_by_loss(loss: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of k rows at even places of their losses."""
    return np.lexsort((keys, loss))[even(len(loss), k)]


def thirds_by_loss(loss: np.ndarray, keys: np.ndarray, most: int) -> np.ndarray:
    n, order = len(loss), np.lexsort((keys, loss))
    if n <= most:
        return order
    a, b, per = n // 3, 2 * n // 3, max(1, most // 3)
    picked = np.concatenate([low + even(high - low, min(high - low, per)) for low, high in ((0, a), (a, b), (b, n)) if high > low])
    return order[picked[:most]]


def subsample(loss: np.ndarray, keys: np.ndarray, most: int, share: float, stratified: bool, seed: int = 0) -> np.ndarray:
    """Places of the rows that train, as increments.subsample() for one learner."""
    share = min(1.0, max(0.05, share))
    low = np.arange(len(loss)) if share >= 1 else np.flatnonzero(loss <= np.quantile(loss, share))
    return low[thirds_by_loss(loss[low], keys[low], most) if stratified else sample(keys[low], most, seed)]


def learner_row(pdf: pd.DataFrame, features: list[str], backend: str, most_rows: int, quantile: float, risk: float, guard: Guard | None, seed: int = 0) -> dict:
    """n, threshold, params, and the guard's seed_count, cutoff and guard, of the learner of these rows (row_index, features)."""
    pdf = pdf.sort_values("row_index")
    keys, x = pdf["row_index"].to_numpy(), matrix(pdf, features)
    mean, std = scales(x)
    model = BACKENDS[backend]((x[sample(keys, most_rows, seed)] - mean) / std, seed=seed)
    spots, place = _distinct(x)  # equal rows have equal losses
    limit = tail_threshold(model.loss((spots - mean) / std)[place], quantile, risk)
    out = {"n": len(x), "threshold": limit, "params": pickle.dumps((mean, std, model)), "seed_count": None, "cutoff": None, "guard": None}
    if guard is not None:
        seen = x[sample(keys, guard.most_rows, seed)]
        if len(seen) >= max(32, guard.rows // 2):
            forest = Forest(seen, guard.trees, 256, seed)
            out |= {"seed_count": len(seen), "cutoff": float(np.quantile(forest.loss(seen), 1 - guard.quantile)), "guard": pickle.dumps(forest)}
    return out


def fit_learners(rows: DataFrame, features: list[str], backend: str, most_rows: int, quantile: float, risk: float, guard: Guard | None) -> DataFrame:
    """learner and learner_row() of each learner of rows (learner, row_index, features), whose rows are all in one task."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        made = learner_row(pdf, features, backend, most_rows, quantile, risk, guard)
        return pd.DataFrame({"learner": [pdf["learner"].iloc[0]]} | {k: [v] for k, v in made.items()})

    shape = "learner string, n long, threshold double, params binary, seed_count long, cutoff double, guard binary"
    return rows.select("learner", "row_index", *features).groupBy("learner").applyInPandas(fit, shape)


def batch_reason(gate: Gate, b: dict) -> str | None:
    """lifecycle.batch_reason() of one batch, with the cap on retrains in its place; without the tests of drift and routes."""
    new = b["learner"].startswith("NEW_")
    if b["kept"] == 0:
        return "benign_conf_filter"
    if gate.freeze_benign and b["is_benign"]:
        return "freeze_benign_incremental"
    if gate.cooldown_windows and new and b["window_id"] - b["birth_window"] < gate.cooldown_windows:
        return "new_learner_cooldown"
    if gate.by_gap:
        since = b["last_trained"] if b["last_trained"] is not None else max(0, b["latest"] - gate.least_rows)
        if b["latest"] - since < gate.least_rows:
            return "increment_gap_not_met"
    elif b["kept"] < gate.least_rows:
        return "increment_min_samples"
    if gate.most_retrains and b["retrains"] >= gate.most_retrains:
        return "max_retrain_per_learner"
    if gate.least_benign_prob is not None and gate.most_exceed is not None and b["benign_prob"] is not None:
        if b["benign_prob"] < gate.least_benign_prob and b["exceed"] > gate.most_exceed:
            return "increment_quality_gate"
    return None
