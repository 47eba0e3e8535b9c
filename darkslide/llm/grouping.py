"""A grouping genetic algorithm for bin packing: what is inherited are whole bins."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np


class Packing:
    """Bin of each item, numbered from 0, and the load of each bin."""

    def __init__(self, bin_of: np.ndarray, sizes: np.ndarray) -> None:
        self.bin_of = np.unique(bin_of, return_inverse=True)[1] if len(bin_of) else bin_of
        self.loads = np.bincount(self.bin_of, sizes, minlength=0).astype(np.int64) if len(bin_of) else np.zeros(0, np.int64)

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first, then fuller ones beside emptier ones; larger is better."""
        return -len(self.loads), float(((self.loads / capacity) ** 2).sum())


def best_fit(items: np.ndarray, sizes: np.ndarray, bin_of: np.ndarray, loads: list[int], capacity: int) -> None:
    """Puts items, in order, into the fullest bin that takes them, or into new ones; changes bin_of and loads."""
    free = sorted((capacity - load, b) for b, load in enumerate(loads))
    for i in items.tolist():
        size = int(sizes[i])
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            room, b = capacity, len(loads)
            loads.append(0)
        bin_of[i] = b
        loads[b] += size
        insort(free, (room - size, b))


def first(sizes: np.ndarray, capacity: int, rng: np.random.Generator, noise: float) -> Packing:
    """Best fit by falling size, sizes blurred by noise."""
    bin_of, loads = np.zeros(len(sizes), np.int64), []
    best_fit(np.argsort(-sizes * (1 + noise * rng.random(len(sizes))), kind="stable"), sizes, bin_of, loads, capacity)
    return Packing(bin_of, sizes)


def cross(a: Packing, b: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """a with some of b's best-filled bins injected: a's bins that share items with them go, and their other items are fitted anew."""
    full = np.argsort(-b.loads, kind="stable")[: max(1, len(b.loads) // 2)]
    injected = np.zeros(len(b.loads), bool)
    injected[rng.choice(full, max(1, len(full) // 3), replace=False)] = True
    come = injected[b.bin_of]
    gone = np.zeros(len(a.loads), bool)
    gone[a.bin_of[come]] = True
    bin_of = np.where(come, len(a.loads) + b.bin_of, a.bin_of)
    displaced = np.flatnonzero(gone[a.bin_of] & ~come)
    return _refit(bin_of, displaced, sizes, capacity)


def mutate(a: Packing, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """a with its emptiest bins and a few others emptied and fitted anew."""
    order = np.argsort(a.loads, kind="stable")
    gone = np.zeros(len(a.loads), bool)
    gone[order[: max(1, len(order) // 50)]] = True
    gone[rng.choice(len(order), min(len(order), 3), replace=False)] = True
    return _refit(a.bin_of.copy(), np.flatnonzero(gone[a.bin_of]), sizes, capacity)


def _refit(bin_of: np.ndarray, displaced: np.ndarray, sizes: np.ndarray, capacity: int) -> Packing:
    stays = np.ones(len(bin_of), bool)
    stays[displaced] = False
    names, dense = np.unique(bin_of[stays], return_inverse=True)
    new = np.zeros(len(bin_of), np.int64)
    new[stays] = dense
    loads = np.bincount(dense, sizes[stays], minlength=len(names)).astype(np.int64).tolist()
    best_fit(displaced[np.argsort(-sizes[displaced], kind="stable")], sizes, new, loads, capacity)
    return Packing(new, sizes)


def evolve(sizes: np.ndarray, capacity: int, seed: int, elites: list[np.ndarray], population: int = 6, generations: int = 12) -> Packing:
    """The best packing found; elites are bins by item that came from elsewhere. Ends early once no packing could have fewer bins."""
    rng = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // capacity)
    people = [Packing(e, sizes) for e in elites] or [first(sizes, capacity, rng, 0.0)]
    key = lambda p: p.fitness(capacity)
    if len(max(people, key=key).loads) > least:
        while len(people) < population:
            people.append(first(sizes, capacity, rng, 0.05 + 0.2 * rng.random()))
        for _ in range(generations):
            people.sort(key=key, reverse=True)
            if len(people[0].loads) <= least:
                break
            children = []
            for _ in range(population // 2):
                i, j = sorted(rng.choice(len(people), 2, replace=False))
                child = cross(people[i], people[j], sizes, capacity, rng)
                children.append(mutate(child, sizes, capacity, rng) if rng.random() < 0.3 else child)
            people = people[: population - len(children)] + children
    return max(people, key=key)
