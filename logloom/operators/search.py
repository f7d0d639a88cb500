"""Parameter search: grids and annealing over clusterings."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from itertools import product

#: Sign that makes larger better, for each metric.
SIGN = {"calinski_harabasz": 1, "davies_bouldin": -1, "xie_beni": -1, "silhouette": 1, "dunn": 1}


def grid(score: Callable[..., float], metric: str, **axes: list) -> tuple[dict, float]:
    """The best point of the full grid (the first of equals)."""
    best, top = {}, -math.inf
    for values in product(*axes.values()):
        point = dict(zip(axes, values, strict=True))
        value = SIGN[metric] * score(**point)
        if value > top:
            best, top = point, value
    return best, SIGN[metric] * top


def anneal(score: Callable[..., float], metric: str, seed: int = 0, start: float = 10.0, end: float = 1e-99, cooling: float = 0.9, share: float = 0.3, **axes: list) -> tuple[dict, float]:
    """Simulated annealing over the grid, seeded, with a budget of a share of its points."""
    chance = random.Random(seed)
    budget = max(1, math.ceil(share * math.prod(len(a) for a in axes.values())))
    point = {k: chance.choice(v) for k, v in axes.items()}
    energy = -SIGN[metric] * score(**point)
    best, low, heat = point, energy, start
    for _ in range(budget):
        if heat < end:
            break
        other = {k: chance.choice(v) for k, v in axes.items()}
        new = -SIGN[metric] * score(**other)
        if new <= energy or math.exp(-(new - energy) / heat) > chance.random():
            point, energy = other, new
        if energy < low:
            best, low = point, energy
        heat *= cooling
    return best, -SIGN[metric] * low
