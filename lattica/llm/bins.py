"""Bin completion over a histogram of lengths: how many sequences of which filling.

Items of one length are alike, so the search runs over the histogram, which has at most as many entries as a sequence
has tokens, whatever the corpus' size. A pattern is a filling and how often it is used.

From the largest remaining length down, the fillings of the room beside it are enumerated in order of waste, the ones of
larger items first, leaving out those that another one dominates (its items can be packed into the other's items); a
subset-sum table says which sums can be reached at all. The incumbent is the better of two dives, which use one filling
at each step as often as all its items last: best fit, and the largest item that fits with the least waste beside it. If it needs more sequences than the lower bound, branch and bound goes over the last
patterns again, prunes what wastes more than the incumbent may, and keeps what it improves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

#: Fillings tried at one step of branch and bound, its steps in all, and the sequences that it opens again.
BRANCHES, STEPS, REOPENED = 6, 4000, 48
Filling = tuple[int, ...]


def dominates(a: Filling, b: Filling) -> bool:
    """Whether b's items can be packed into bins of the sizes of a's items."""
    if sum(b) > sum(a) or max(b, default=0) > max(a, default=0):
        return False
    room = list(a)

    def place(i: int) -> bool:
        if i == len(b):
            return True
        tried = set()
        for k, r in enumerate(room):
            if r >= b[i] and r not in tried:
                tried.add(r)
                room[k] -= b[i]
                if place(i + 1):
                    return True
                room[k] += b[i]
        return False

    return place(0)


def fillings(counts: dict[int, int], room: int, limit: int) -> Iterator[Filling]:
    """Undominated fillings of at most ``room`` in order of waste; at most ``limit``, the empty one if nothing fits."""
    if counts.get(room):  # dominates all others
        yield (room,)
        return
    sizes = sorted(s for s, n in counts.items() if n and s <= room)
    if not sizes:
        yield ()
        return
    if limit == 1:  # an exact pair is the usual case and needs no table
        for s in reversed(sizes):
            if 2 * s < room:
                break
            if counts.get(room - s, 0) > (room == 2 * s):
                yield (s, room - s)
                return
    mask = (1 << room + 1) - 1
    reach = [1]  # bit k of reach[i]: the i smallest sizes can add up to k
    for s in sizes:
        bits = reach[-1]
        for _ in range(min(counts[s], room // s)):
            more = bits | bits << s & mask
            if more == bits:
                break
            bits = more
        reach.append(bits)
    made: list[Filling] = []

    def build(i: int, left: int, chosen: Filling) -> Iterator[Filling]:
        if not left:
            yield chosen
            return
        if not i or not reach[i] >> left & 1:
            return
        s = sizes[i - 1]
        for n in range(min(counts[s], left // s), -1, -1):
            if reach[i - 1] >> left - n * s & 1:
                yield from build(i - 1, left - n * s, chosen + (s,) * n)

    best = reach[-1].bit_length() - 1
    looked = 0
    for total in range(best, 0, -1):
        for f in build(len(sizes), total, ()):
            looked += 1
            if not any(dominates(x, f) for x in made):
                made.append(f)
                yield f
            if len(made) >= limit or looked > 8 * limit:
                return


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of total size and the bound of Martello and Toth."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    sizes = sorted(counts)
    for k in {s for s in sizes if 2 * s <= capacity} | {1}:
        large = sum(n for s, n in counts.items() if s > capacity - k)
        middle = [(s, n) for s, n in counts.items() if capacity - k >= s > capacity // 2]
        small = sum(s * n for s, n in counts.items() if k <= s <= capacity // 2)
        n_middle = sum(n for _, n in middle)
        rest = small - (n_middle * capacity - sum(s * n for s, n in middle))
        best = max(best, large + n_middle + max(0, -(-rest // capacity)))
    return best


def best_fit(counts: dict[int, int], room: int) -> Filling:
    """The largest that fits, again and again."""
    left, out = dict(counts), []
    while largest := max((s for s, n in left.items() if n and s <= room), default=0):
        left[largest] -= 1
        room -= largest
        out.append(largest)
    return tuple(out)


def completed(counts: dict[int, int], room: int) -> Filling:
    """The largest that fits, and beside it the undominated filling of least waste."""
    largest = max((s for s, n in counts.items() if n and s <= room), default=0)
    if not largest:
        return ()
    left = dict(counts)
    left[largest] -= 1
    return (largest, *next(fillings(left, room - largest, 1)))


def dive(counts: dict[int, int], capacity: int, choose) -> list[tuple[Filling, int]]:
    """One filling around each largest item, used as often as all its items last."""
    counts, out = {s: n for s, n in counts.items() if n}, []
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        pattern = (largest, *choose(counts, capacity - largest))
        counts[largest] += 1
        need = Counter(pattern)
        times = min(counts[s] // n for s, n in need.items())
        out.append((pattern, times))
        for s, n in need.items():
            counts[s] -= n * times
            if not counts[s]:
                del counts[s]
    return out


def complete(counts: dict[int, int], capacity: int, incumbent: int, bound: int, steps: int) -> list[Filling] | None:
    """Fillings of fewer than ``incumbent`` sequences, or None if none are found within ``steps``."""
    spare = (incumbent - 1) * capacity - sum(s * n for s, n in counts.items())
    left = [steps]

    def go(counts: dict[int, int], waste: int, used: int) -> list[Filling] | None:
        if not counts:
            return []
        left[0] -= 1
        if left[0] < 0 or used + 1 >= incumbent:
            return None
        largest = max(counts)
        rest = dict(counts)
        rest[largest] -= 1
        for f in fillings(rest, capacity - largest, BRANCHES):
            more = waste + capacity - largest - sum(f)
            if more > spare:
                break  # fillings come in order of waste
            after = dict(rest)
            for s in f:
                after[s] -= 1
            got = go({s: n for s, n in after.items() if n}, more, used + 1)
            if got is not None:
                return [(largest, *f), *got]
            if left[0] < 0:
                return None
        return None

    return go(counts, 0, 0) if incumbent > bound else None


def pack_lengths(counts: dict[int, int], capacity: int, steps: int = STEPS, reopened: int = REOPENED) -> list[tuple[Filling, int]]:
    """Patterns that use every item once: (lengths in descending order, number of sequences)."""
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("lengths must be between 1 and the capacity")
    patterns = min((dive(counts, capacity, choose) for choose in (best_fit, completed)), key=lambda p: sum(n for _, n in p))
    bound = lower_bound(counts, capacity) if counts else 0
    while sum(n for _, n in patterns) > bound:
        tail: list[Filling] = []
        head = list(patterns)
        while head and len(tail) < reopened:  # those that waste most come last in the dive
            f, n = head.pop()
            take = min(n, reopened - len(tail))
            tail += [f] * take
            if n > take:
                head.append((f, n - take))
        items = Counter(s for f in tail for s in f)
        got = complete(dict(items), capacity, len(tail), lower_bound(items, capacity), steps)
        if got is None:
            break
        patterns = head + [(f, n) for f, n in Counter(tuple(sorted(f, reverse=True)) for f in got).items()]
    return patterns
