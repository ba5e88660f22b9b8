"""Branch and bound over the covers of groups: what a task does with its rows."""

from __future__ import annotations


def reduced(need: list[list[int]], weights: list[int]) -> tuple[list[list[int]], list[int]]:
    """Groups without those that hold another one, and without bits that are never better
    than another: whose groups that one has too, with more weight. Any smallest cover of
    the largest weight covers these, and none of the others is one."""
    groups = sorted({frozenset(g) for g in need}, key=lambda g: (len(g), sorted(g)))
    while True:
        kept: list[frozenset] = []
        has: dict[int, set[int]] = {}
        for g in groups:
            # a group within this one has one of its bits
            if any(kept[i] <= g for b in g for i in has.get(b, ())):
                continue
            for b in g:
                has.setdefault(b, set()).add(len(kept))
            kept.append(g)
        worse = set()
        for b, own in has.items():
            rivals = set.intersection(*(set(kept[i]) for i in own)) - {b}
            if any(weights[r] > weights[b] for r in rivals):
                worse.add(b)
        if not worse and len(kept) == len(groups):
            return [sorted(g) for g in kept], weights
        groups = sorted({g - worse for g in kept}, key=lambda g: (len(g), sorted(g)))


def greedy(need: list[list[int]], weights: list[int]) -> list[int]:
    """A cover: again and again the bit of most groups that are left (then of most weight)."""
    left, out = [set(g) for g in need], []
    while left:
        counts: dict[int, int] = {}
        for g in left:
            for b in g:
                counts[b] = counts.get(b, 0) + 1
        best = max(counts, key=lambda b: (counts[b], weights[b], -b))
        out.append(best)
        left = [g for g in left if best not in g]
    return sorted(out)


class Search:
    """The best covers from given sub-problems, at most ``budget`` of them looked at."""

    def __init__(self, need: list[list[int]], weights: list[int], size: int, weight: int, budget: int):
        self.masks = [sum(1 << b for b in g) for g in need]
        self.weights, self.size, self.weight, self.budget = weights, size, weight, budget
        self.best: list[tuple[int, ...]] = []
        self.open: list[tuple[list[int], list[int]]] = []

    def run(self, chosen: list[int], banned: list[int]) -> None:
        have = sum(1 << b for b in chosen)
        waiting = [(tuple(chosen), have, sum(1 << b for b in banned), [m for m in self.masks if not m & have])]
        while waiting:
            taken, have, ban, left = waiting.pop()
            if self.budget <= 0:
                self.open.append((list(taken), _bits(ban)))
                continue
            self.budget -= 1
            weight = sum(self.weights[b] for b in taken)
            if not left:
                if (len(taken), -weight) < (self.size, -self.weight):
                    self.size, self.weight, self.best = len(taken), weight, []
                if (len(taken), weight) == (self.size, self.weight):
                    self.best.append(taken)
                continue
            free = [m & ~ban for m in left]
            if not all(free):
                continue
            more, most = self._bound(free)
            if (len(taken) + more, -(weight + most)) > (self.size, -self.weight):
                continue
            branch = _bits(min(free, key=lambda m: (m.bit_count(), m)))
            # every branch bans the bits of those before it, so no set is met twice
            parts, barred = [], ban
            for b in sorted(branch, key=lambda b: (-sum(m >> b & 1 for m in left), -self.weights[b])):
                parts.append(((*taken, b), have | 1 << b, barred, [m for m in left if not m >> b & 1]))
                barred |= 1 << b
            waiting += parts[::-1]

    def _bound(self, free: list[int]) -> tuple[int, int]:
        """How many bits are needed at least, and the most that so many can weigh: disjoint
        groups need a bit each."""
        used = count = weight = 0
        for m in sorted(free, key=int.bit_count):
            if not m & used:
                used |= m
                count += 1
                weight += max(self.weights[b] for b in _bits(m))
        # a cover of just so many bits has them all in these groups
        return count, weight


def _bits(mask: int) -> list[int]:
    out = []
    while mask:
        low = mask & -mask
        out.append(low.bit_length() - 1)
        mask ^= low
    return out
