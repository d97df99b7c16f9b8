"""Bin completion for a histogram of sizes: branch and bound over whole fillings of the bin around the largest size.

Equal sizes are one class with a count, so the work depends on the number of different sizes (at most the capacity), never on
the number of items. A branch applies one filling as often as its classes last.
"""

from __future__ import annotations

from bisect import bisect_right

Fill = tuple[int, ...]


def _fits_into(small: Fill, large: Fill) -> bool:
    """True if the sizes of ``small`` can be parted into groups that fit into the sizes of ``large``."""
    room = list(large)

    def place(i: int) -> bool:
        if i == len(small):
            return True
        for j in dict.fromkeys(range(len(room))):
            if room[j] >= small[i]:
                room[j] -= small[i]
                if place(i + 1):
                    return True
                room[j] += small[i]
        return False

    return sum(small) <= sum(large) and place(0)


def undominated(fills: list[Fill]) -> list[Fill]:
    """Drop every filling whose sizes fit into those of another; the least waste first, then the larger sizes."""
    kept: list[Fill] = []
    for f in sorted(set(fills), key=lambda f: (-sum(f), len(f), tuple(-x for x in f))):
        if len(f) > 6 or not any(len(k) <= 6 and _fits_into(f, k) for k in kept):
            kept.append(f)
    return kept


def fillings(counts: dict[int, int], room: int, effort: int, wanted: int) -> list[Fill]:
    """Maximal fillings of ``room``, the larger sizes first, until ``wanted`` without waste are found or the effort is spent."""
    sizes = sorted(s for s, c in counts.items() if c and s <= room)
    found: list[Fill] = []
    exact = 0
    left = dict.fromkeys(sizes, 0)
    for s in sizes:
        left[s] = counts[s]
    steps = 0

    def go(room: int, top: int, chosen: list[int]) -> bool:
        nonlocal steps, exact
        steps += 1
        at = bisect_right(sizes, min(room, top)) - 1
        while at >= 0 and not left[sizes[at]]:
            at -= 1
        if at < 0:
            # nothing of at most ``top`` fits; the filling is maximal only if nothing larger fits either
            if not any(left[s] for s in sizes[bisect_right(sizes, top) : bisect_right(sizes, room)]):
                found.append(tuple(chosen))
                exact += room == 0
            return exact >= wanted or steps > effort
        if room in left and room <= top and left[room]:
            found.append((*chosen, room))  # one size that closes the bin dominates every other way to go on
            exact += 1
            return exact >= wanted or steps > effort
        for i in range(at, -1, -1):
            s = sizes[i]
            if not left[s]:
                continue
            left[s] -= 1
            chosen.append(s)
            stop = go(room - s, s, chosen)
            chosen.pop()
            left[s] += 1
            if stop:
                return True
        return False

    go(room, room, [])
    return undominated(found)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Fill, int]]:
    """Best-fit decreasing over classes: the incumbent of the search."""
    left, out = dict(counts), []
    while left:
        top = max(left)
        fill, room = [top], capacity - top
        use = {top: 1}
        while True:
            fit = [s for s, c in left.items() if s <= room and c > use.get(s, 0)]
            if not fit:
                break
            s = max(fit)
            fill.append(s)
            use[s] = use.get(s, 0) + 1
            room -= s
        times = min(left[s] // k for s, k in use.items())
        out.append((tuple(fill), times))
        for s, k in use.items():
            left[s] -= times * k
            if not left[s]:
                del left[s]
    return out


def bins(plan: list[tuple[Fill, int]]) -> int:
    return sum(n for _, n in plan)


def complete(counts: dict[int, int], capacity: int, effort: int = 400, branches: int = 4, nodes: int = 6000) -> list[tuple[Fill, int]]:
    """Fillings with their numbers that hold every item, as few bins as the search finds.

    ``effort`` bounds the steps of one enumeration, ``branches`` the fillings tried at a node without waste, ``nodes`` the
    whole search; they bound the search for improvements, while every item is packed in any case.
    """
    counts = {s: c for s, c in counts.items() if c}
    best = best_fit(counts, capacity)
    least = -(-sum(s * c for s, c in counts.items()) // capacity)
    if bins(best) <= least:
        return best
    # a size and its exact complement: no other filling around the larger one can be better
    head: list[tuple[Fill, int]] = []
    left = dict(counts)
    for s in sorted(left, reverse=True):
        rest = capacity - s
        if rest == 0:
            head.append(((s,), left.pop(s)))
        elif s > rest and left.get(rest):
            n = min(left[s], left[rest])
            head.append(((s, rest), n))
            left[s] -= n
            left[rest] -= n
        elif s == rest and left[s] > 1:
            head.append(((s, s), left[s] // 2))
            left[s] %= 2
    left = {s: c for s, c in left.items() if c}
    stack = [(left, head, bins(head))]
    seen = 0
    while stack and seen < nodes and bins(best) > least:
        left, plan, used = stack.pop()
        seen += 1
        if not left:
            if used < bins(best):
                best = plan
            continue
        total = sum(s * c for s, c in left.items())
        if used + -(-total // capacity) >= bins(best):
            continue  # the waste so far cannot be made good
        top = max(left)
        inner = dict(left)
        inner[top] -= 1
        fills = fillings(inner, capacity - top, effort, branches) or [()]
        nexts = []
        for f in fills[:branches]:
            whole = (top, *f)
            use = {s: whole.count(s) for s in whole}
            times = min(left[s] // k for s, k in use.items())
            after = {s: c - times * use.get(s, 0) for s, c in left.items()}
            nexts.append(({s: c for s, c in after.items() if c}, [*plan, (whole, times)], used + times))
        stack.extend(reversed(nexts))
    return best
