"""Graph searches inside one document: components, closure, reachability labels, merge points.

Nodes are any hashable values. All loops are over nodes and edges, none is recursive.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

#: Up to this many components the closure is kept as bit sets, beyond it each is searched anew.
BIT_SETS = 20_000


class Graph:
    """The strongly connected components of a directed graph, successors numbered before predecessors."""

    def __init__(self, sources: list, targets: list):
        number: dict = {}
        for x in sources:
            number.setdefault(x, len(number))
        for x in targets:
            number.setdefault(x, len(number))
        self.nodes, self.number = list(number), number
        self.next: list[list[int]] = [[] for _ in number]
        for a, b in zip(sources, targets):
            self.next[number[a]].append(number[b])
        self._components()

    def _components(self) -> None:
        n = len(self.nodes)
        order, low, self.of = [0] * n, [0] * n, [-1] * n
        self.members: list[list[int]] = []
        count, waiting = 0, []
        for root in range(n):
            if order[root]:
                continue
            count += 1
            order[root] = low[root] = count
            waiting.append(root)
            path = [(root, iter(self.next[root]))]
            while path:
                at, rest = path[-1]
                for to in rest:
                    if not order[to]:
                        count += 1
                        order[to] = low[to] = count
                        waiting.append(to)
                        path.append((to, iter(self.next[to])))
                        break
                    if self.of[to] < 0:
                        low[at] = min(low[at], order[to])
                else:
                    path.pop()
                    if path:
                        low[path[-1][0]] = min(low[path[-1][0]], low[at])
                    if low[at] == order[at]:
                        group = [waiting.pop()]
                        while group[-1] != at:
                            group.append(waiting.pop())
                        for x in group:
                            self.of[x] = len(self.members)
                        self.members.append(group)
        self.after: list[list[int]] = [[] for _ in self.members]
        self.cyclic = [len(m) > 1 for m in self.members]
        for a, tos in enumerate(self.next):
            for b in tos:
                if self.of[a] == self.of[b]:
                    self.cyclic[self.of[a]] = self.cyclic[self.of[a]] or a == b
                else:
                    self.after[self.of[a]].append(self.of[b])
        self.after = [sorted(set(x)) for x in self.after]


def depth_first(start, after: dict, stops: set) -> Iterator:
    """``start`` and what it leads to without passing ``stops``, each node before its successors and all that
    a successor leads to before the next one."""
    seen = {start}
    yield start
    path = [iter(after.get(start, ()))]
    while path:
        for to in path[-1]:
            if to not in seen and to not in stops:
                seen.add(to)
                yield to
                path.append(iter(after.get(to, ())))
                break
        else:
            path.pop()


def closure(sources: list, targets: list) -> Iterator[tuple]:
    """Every pair of nodes with a path of one edge or more."""
    g = Graph(sources, targets)
    reached: list[int] = []
    for c, after in enumerate(g.after):
        if len(g.members) <= BIT_SETS:
            bits = 1 << c if g.cyclic[c] else 0
            for d in after:
                bits |= reached[d] | 1 << d
            reached.append(bits)
            digits = bin(bits)[:1:-1]
            found, at = [], digits.find("1")
            while at >= 0:
                found.append(at)
                at = digits.find("1", at + 1)
        else:
            seen, front = set(after), list(after)
            while front:
                new = [d for d in g.after[front.pop()] if d not in seen]
                seen.update(new)
                front += new
            found = [*seen, *([c] if g.cyclic[c] else [])]
        ends = [g.nodes[b] for d in found for b in g.members[d]]
        for a in g.members[c]:
            for b in ends:
                yield g.nodes[a], b


class Labels:
    """Interval labels of components. ``first`` to ``last`` are the preorder numbers below a component in a
    spanning forest: what lies in them is reached. ``low`` to ``rank`` are postorder numbers over all
    edges, for two orders of the successors: what is reached lies in them."""

    def __init__(self, g: Graph):
        n = len(g.members)
        self.first, self.last = [0] * n, [0] * n
        self.rank, self.low = [[0] * n, [0] * n], [[0] * n, [0] * n]
        entered = set(d for after in g.after for d in after)
        roots = [c for c in range(n - 1, -1, -1) if c not in entered]
        for turn in range(2):
            seen, count, done = [False] * n, 0, 0
            rank, low = self.rank[turn], self.low[turn]
            for root in roots if turn == 0 else roots[::-1]:
                seen[root] = True
                if turn == 0:
                    self.first[root] = count
                count += 1
                path = [(root, iter(g.after[root][::-1] if turn == 0 else g.after[root]))]
                while path:
                    at, rest = path[-1]
                    for to in rest:
                        if not seen[to]:
                            seen[to] = True
                            if turn == 0:
                                self.first[to] = count
                            count += 1
                            path.append((to, iter(g.after[to][::-1] if turn == 0 else g.after[to])))
                            break
                    else:
                        path.pop()
                        rank[at] = done
                        low[at] = min([done, *(low[d] for d in g.after[at])])
                        done += 1
                        if turn == 0:
                            self.last[at] = count - 1

    def may(self, c: int, d: int) -> bool:
        return all(low[c] <= low[d] and rank[d] <= rank[c] for low, rank in zip(self.low, self.rank))

    def sure(self, c: int, d: int) -> bool:
        return self.first[c] <= self.first[d] <= self.last[c]


def labels(sources: list, targets: list) -> Iterator[tuple]:
    """``node, component, cyclic, first, last, low, rank`` of every node; the last two have two numbers."""
    g = Graph(sources, targets)
    m = Labels(g)
    for node, c in zip(g.nodes, g.of):
        yield node, c, g.cyclic[c], m.first[c], m.last[c], [x[c] for x in m.low], [x[c] for x in m.rank]


def searcher(sources: list, targets: list) -> Callable[[object, object], bool]:
    """A function that says exactly whether one node reaches another, searching only where labels allow."""
    g = Graph(sources, targets)
    m = Labels(g)

    def reaches(a, b) -> bool:
        if a not in g.number or b not in g.number:
            return False
        c, goal = g.of[g.number[a]], g.of[g.number[b]]
        if c == goal:
            return g.cyclic[c]
        seen, front = {c}, [c]
        while front:
            at = front.pop()
            if m.sure(at, goal):
                return True
            new = [d for d in g.after[at] if d not in seen and m.may(d, goal)]
            seen.update(new)
            front += new
        return False

    return reaches


class _Sums:
    """Numbers at places, with the first place where their running sum falls below zero."""

    def __init__(self, places: int):
        self.size = 1 << max(0, places - 1).bit_length()
        self.total, self.low = [0] * (2 * self.size), [0] * (2 * self.size)

    def add(self, place: int, value: int) -> None:
        total, low = self.total, self.low
        at = place + self.size
        total[at] += value
        low[at] = total[at]
        at >>= 1
        while at:
            left = 2 * at
            total[at] = total[left] + total[left + 1]
            low[at] = min(low[left], total[left] + low[left + 1])
            at >>= 1

    def first_below(self) -> int | None:
        if self.low[1] >= 0:
            return None
        at, before = 1, 0
        while at < self.size:
            at *= 2
            if before + self.low[at] >= 0:
                before += self.total[at]
                at += 1
        return at - self.size


def merge_points(elements: list, targets: list, at_start: list, at_target: list, gateway: list) -> Iterator[tuple]:
    """``element, merge point or None, opened gateways`` for each element ``(position, key)``.

    Flows are given in text order by the keys of their targets, the positions of both ends, and whether
    the target is a gateway. A gateway with one incoming flow opens there. Seen from a flow, a later
    one closes if its target was met in between. Going back over the flows, each adds what it opens and
    makes the next flow to its target close, so one tree of running sums serves all elements: the first
    place where more was closed than opened, the element itself counting as open, is the merge point.
    """
    n = len(targets)
    least, following = [None] * (n + 1), [None] * n
    met: dict = {}
    into: dict = {}
    for j in range(n - 1, -1, -1):
        least[j] = at_target[j] if least[j + 1] is None else min(at_target[j], least[j + 1])
        following[j] = met.get(targets[j])
        met[targets[j]] = j
        into.setdefault(targets[j], []).append(j)
    opens = [g and len(into[x]) == 1 for g, x in zip(gateway, targets)]
    opened = [j for j in range(n) if opens[j]]
    asked = []
    for place, key in elements:
        after = least[bisect_left(at_start, place)]
        asked.append((bisect_left(at_start, place if after is None else min(place, after)), key))
    sums, value, now = _Sums(n), [0] * n, n

    def add(j: int, x: int) -> None:
        value[j] += x
        sums.add(j, x)

    for begin, key in sorted(asked, key=lambda x: -x[0]):
        while now > begin:
            now -= 1
            if opens[now]:
                add(now, 1)
            if following[now] is not None:
                add(following[now], -1)
        own = [(j, value[j]) for j in into.get(key, ()) if j >= begin and value[j]]
        for j, x in own:
            sums.add(j, -x)
        end = sums.first_below()
        for j, x in own:
            sums.add(j, x)
        until = n if end is None else end + 1
        inside = opened[bisect_left(opened, begin) : bisect_right(opened, until - 1)]
        yield key, None if end is None else targets[end], list(dict.fromkeys(targets[j] for j in inside if targets[j] != key))


def until_merge(start, stop, after: dict, partners: dict, place: dict) -> Iterator:
    """``start`` and what it leads to over targets placed before ``stop`` (all if None), each target with
    all its partners, and on from these."""
    seen, met, front = {start}, set(), [start]
    yield start
    while front:
        for to in after.get(front.pop(), ()):
            if to in met or stop is not None and not place[to] < stop:
                continue
            met.add(to)
            line = [to]
            while line:
                x = line.pop()
                if x not in seen:
                    seen.add(x)
                    front.append(x)
                    yield x
                new = [p for p in partners.get(x, ()) if p not in met]
                met.update(new)
                line += new


def next_of(edges: list) -> dict:
    """What each node leads to in one step, without repeats."""
    found: dict = {}
    for a, b in edges:
        found.setdefault(a, {})[b] = None
    return found


def led_to(start, after: dict) -> dict:
    """What ``start`` leads to in one step or more."""
    seen: dict = {}
    line = [start]
    while line:
        new = [x for x in after.get(line.pop(), ()) if x not in seen]
        seen.update(dict.fromkeys(new))
        line += new
    return seen


def bits_of(bits: int) -> Iterator[int]:
    """The places of the ones of a bit set, rising."""
    digits = bin(bits)[:1:-1]
    at = digits.find("1")
    while at >= 0:
        yield at
        at = digits.find("1", at + 1)


def pairs_once(rows: dict) -> Iterator[tuple[int, int]]:
    """The pairs of ``i`` and the bits of ``rows[i]``, none with itself; of a pair and its mirror the rising one."""
    for i, bits in rows.items():
        for j in bits_of(bits & ~(1 << i)):
            if i < j or not rows.get(j, 0) >> i & 1:
                yield i, j


def reached_bits(edges: list, number: dict) -> Callable[[object], int]:
    """A function from a node to the bit set of the numbered nodes that it reaches."""
    g = Graph([a for a, _ in edges], [b for _, b in edges])
    if len(g.members) > BIT_SETS:
        over = next_of(edges)
        return lambda x: sum(1 << number[y] for y in led_to(x, over) if y in number)
    own = [sum(1 << number[g.nodes[x]] for x in m if g.nodes[x] in number) for m in g.members]
    reached: list[int] = []
    for c, after in enumerate(g.after):
        bits = own[c] if g.cyclic[c] else 0
        for d in after:
            bits |= reached[d] | own[d]
        reached.append(bits)
    return lambda x: reached[g.of[g.number[x]]]
