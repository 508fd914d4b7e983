"""Weights of comparison levels, estimated by expectation-maximization.

Pairs are compared in a few components, each with a fixed number of levels; a missing value is a level like
others. Only the counts of the patterns of levels are needed, at most as many rows as there are patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

ROUNDS, TOLERANCE = 500, 1e-7
#: Pairs that the first guess of each class counts for; it steadies the weights of small tables and is lost in large ones.
GUESS = 200


@dataclass(frozen=True)
class Weights:
    """prior: log-odds of a match; log: for each component the log-odds that each level adds."""

    prior: float
    log: dict[str, list[float]]
    posterior: np.ndarray


def estimate(counts: pd.DataFrame, levels: dict[str, int], never: np.ndarray | None = None, guess: dict[str, tuple[list[float], list[float]]] | None = None) -> Weights:
    """counts: one row per pattern of levels, and n. Components are independent among matches and among the
    others. Level 0 is agreement and the last one disagreement; the first guess says that matches mostly
    agree, so that the two classes can't change places. guess: shares of the levels among matches and among
    the others, for components that aren't so. never: patterns that are no matches by definition; what the
    components say is learnt from them too."""
    never = np.zeros(len(counts), bool) if never is None else never
    fields = list(levels)
    n = counts["n"].to_numpy(float)
    x = counts[fields].to_numpy(int)
    m, u = {}, {}
    for f, k in levels.items():
        usual = [0.7 if i == 0 else 0.02 if i == k - 1 else 0.28 / max(1, k - 2) for i in range(k)], [0.2 if i == 0 else 0.5 if i == k - 1 else 0.3 / max(1, k - 2) for i in range(k)]
        m[f], u[f] = (np.array(x) / sum(x) for x in (guess or {}).get(f, usual))
    first = {f: (GUESS * m[f], GUESS * u[f]) for f in fields}
    share, before, post = 0.5, -np.inf, np.zeros(len(n))
    for _ in range(ROUNDS):
        lm = np.log(share) + sum(np.log(m[f][x[:, i]]) for i, f in enumerate(fields))
        lu = np.log1p(-share) + sum(np.log(u[f][x[:, i]]) for i, f in enumerate(fields))
        top = np.maximum(lm, lu)
        total = top + np.log(np.exp(lm - top) + np.exp(lu - top))
        post = np.where(never, 0.0, np.exp(lm - total))
        total = np.where(never, lu, total)
        wm, wu = n * post, n * (1 - post)
        share = (wm.sum() + 5) / (n.sum() + 10)
        for i, f in enumerate(fields):
            m[f] = (np.bincount(x[:, i], wm, levels[f]) + first[f][0]) / (wm.sum() + GUESS)
            u[f] = (np.bincount(x[:, i], wu, levels[f]) + first[f][1]) / (wu.sum() + GUESS)
        now = float((n * total).sum())
        if abs(now - before) <= TOLERANCE * max(1.0, abs(now)):
            break
        before = now
    return Weights(float(np.log(share) - np.log1p(-share)), {f: np.log(m[f] / u[f]).tolist() for f in fields}, post)
