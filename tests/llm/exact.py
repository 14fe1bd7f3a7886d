"""Plain Python answers that the operators' tests are held against."""

from collections import Counter, defaultdict


def near_components(rows, words=4, percent=80):
    """id -> (size of the shingle set, smallest id that links reach), by a join on the rarest shingles of each set that loses no link."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        n = min(words, len(w))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
    classes = defaultdict(list)
    for i in sorted(sets):
        if sets[i]:
            classes[sets[i]].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(a, b):
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)

    for own in classes.values():
        for b in own[1:]:
            join(own[0], b)
    count = Counter(e for s in classes for e in s)
    holders = defaultdict(list)
    for s in sorted(classes, key=len):
        order = sorted(s, key=lambda e: (count[e], e))
        met = set()
        for e in order[: len(s) - -(-len(s) * percent // 100) + 1]:
            met.update(o for o in holders[e] if 100 * len(o) >= percent * len(s))
            holders[e].append(s)
        for o in met:
            both = len(s & o)
            if 100 * both >= percent * (len(s) + len(o) - both):
                join(classes[s][0], classes[o][0])
    return {i: (len(sets[i]), root(i)) for i in sets}


def maximal_segments(x):
    """All maximal scoring segments (score, start, end), by their definition: the best segment, shortest of equals, then the same on either side of it."""
    out = []

    def look(a, b):
        best = None
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += x[j]
                if total > 0 and (best is None or (total, i - j) > (best[0], best[1] - best[2] + 1)):
                    best = (total, i, j + 1)
        if best:
            out.append(best)
            look(a, best[1])
            look(best[2], b)

    look(0, len(x))
    return sorted(out, key=lambda s: s[1])


def js_distance(p, q):
    """Jensen-Shannon distance in bits of two histograms."""
    from math import log2, sqrt

    if not sum(p) or not sum(q):
        return 1.0
    p, q = [v / sum(p) for v in p], [v / sum(q) for v in q]
    kl = lambda a, m: sum(x * log2(x / y) for x, y in zip(a, m, strict=True) if x)
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    return sqrt(max(0.0, (kl(p, m) + kl(q, m)) / 2))


def edit_leaks(words, item, most):
    """Whether some window of words lies within ``most`` word edits of the item (Sellers' algorithm)."""
    row = list(range(len(item) + 1))
    least = row[-1]
    for w in words:
        new = [0]
        for k, x in enumerate(item, 1):
            new.append(min(row[k] + 1, new[k - 1] + 1, row[k - 1] + (x != w)))
        row = new
        least = min(least, row[-1])
    return least <= most
