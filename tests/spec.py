"""Plain versions of the graph walks, by enumeration, to hold the kernels against."""

from __future__ import annotations


class Spec:
    def __init__(self, priority, counts, edges):
        self.priority, self.counts = priority, counts
        self.succ, self.pred = {}, {}
        for a, b in edges:
            self.succ.setdefault(a, []).append(b)
            self.pred.setdefault(b, []).append(a)

    def sort(self, ns):
        return sorted(ns, key=lambda n: (-self.priority[n], n))

    def value(self, path):
        i, s, v, f = (sum(self.counts[n][k] for n in path) for k in range(4))
        total = 80 * (i > 0) + 100 * (s > 0) + 180 * (i > 0 and s > 0) + 140 * (i > 0 and s > 0 and v == 0 and f == 0)
        return total + 40 * s + 25 * i + 8 * v + 5 * f + 10 * len(path) + sum(self.priority[n] for n in path)

    def distances(self, root, side, depth):
        dist, ring = {root: 0}, [root]
        for d in range(1, depth + 1):
            ring = [n for m in ring for n in side.get(m, ()) if n not in dist and not dist.update({n: d})]
        return dist

    def all_shortest(self, root, depth, reverse):
        """Every shortest path to every node, in the order of breadth-first discovery."""
        side = self.pred if reverse else self.succ
        dist = self.distances(root, side, depth)
        out, level = [], [[root]]
        for d in range(1, depth + 1):
            level = [[*p, n] for p in level for n in self.sort(side.get(p[-1], ())) if dist.get(n) == d]
            out += level
        return out

    def directed(self, root, depth, reverse=False):
        best = {}
        for p in self.all_shortest(root, depth, reverse):
            q = p[::-1] if reverse else p
            if p[-1] not in best or self.value(q) > self.value(best[p[-1]]):
                best[p[-1]] = q
        return sorted(best.values(), key=lambda p: (-self.value(p), str(p)))

    def ranked(self, root, depth, limit):
        a, b = self.directed(root, depth, True), self.directed(root, depth)
        chains = [("upstream", p) for p in a] + [("downstream", p) for p in b] + [("through", x + y[1:]) for x in a[:limit] for y in b[:limit]]
        return sorted(chains, key=lambda c: (-self.value(c[1]), c[0] != "through", str(c[1])))[:limit]
