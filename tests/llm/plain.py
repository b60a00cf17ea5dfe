"""Plain single-process versions of the operators, for comparison on small tables."""

import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def substrings(rows, width):
    """(id, n_words, kept words) by looking at every window of every document."""
    first = {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(text)
        for a in range(len(w) - width + 1):
            first.setdefault(tuple(w[a : a + width]), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = set()
        if i is not None:
            for a in range(len(w) - width + 1):
                if first[tuple(w[a : a + width])] < i:
                    gone.update(range(a, a + width))
        out.append((i, len(w), [x for k, x in enumerate(w) if k not in gone]))
    return out


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[a : a + 5]) for a in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard(rows):
    """(id, n_shingles, component id) over all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            holders[g].append(k)
    both = Counter((a, b) for held in holders.values() for n, a in enumerate(held) for b in held[n + 1 :])
    for (a, b), n in both.items():
        if None not in (rows[a][0], rows[b][0]) and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        root = find(k)
        least[root] = i if least.get(root) is None else min(least[root], i)
    return [(i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)]


def exact(rows):
    """(id, keep_id, group_size, kept): the longest text of each group, then the smallest id."""
    groups = defaultdict(list)
    for k, (i, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i, k))
    out = {}
    for members in groups.values():
        best = min(members, key=lambda m: (m[0], m[1], m[2] if m[2] is not None else 0, m[3]))
        for m in members:
            out[m[3]] = (m[2], best[2], len(members), m[3] == best[3])
    return [out[k] for k in range(len(rows))]


def runs(words, least=24, times=3):
    """(start, length, period) by trying every period at every place, and the words kept."""
    n, found, covered = len(words), [], set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                span = (i, i + length)
                if not any(p < q and s <= span[0] and s + m >= span[1] for s, m, p in found):
                    found.append((i, length, q))
            i = j + 1
    for s, m, q in found:
        covered.update(range(s + q, s + m))
    return sorted(found, key=lambda r: (r[0], r[2])), [w for k, w in enumerate(words) if k not in covered]


def sha(*parts):
    import hashlib

    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(values):
    """Root of a tree in threes, and for each value the (left, right) siblings on its way up."""
    ways = [[] for _ in values]
    owner = [[k] for k in range(len(values))]
    while len(values) > 1:
        up, owners = [], []
        for a in range(0, len(values), 3):
            run = values[a : a + 3]
            for slot in range(len(run)):
                for k in owner[a + slot]:
                    ways[k].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            up.append(sha(*run))
            owners.append([k for o in owner[a : a + 3] for k in o])
        values, owner = up, owners
    return values[0], ways


def manifest(rows):
    """(id, leaf, subroot, root, siblings, folded, verified) of rows (source, id, leaf, now)."""
    groups = defaultdict(list)
    for source, i, leaf, now in rows:
        groups[source].append((i is not None, i or 0, leaf, now, i))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: r[:4])
    built = {s: tree([r[2] for r in groups[s]]) for s in names}
    root, over = tree([built[s][0] for s in names]) if names else (None, [])
    out = []
    for s, more in zip(names, over):
        for (_, _, leaf, now, i), way in zip(groups[s], built[s][1]):
            value = now
            for left, right in way + more:
                value = sha(left, value, right)
            out.append((i, leaf, built[s][0], root, "".join(a + b for a, b in way + more), value, value == root))
    return out


def targets(sizes, weights, cap, share=1.0):
    """Target of each source: what a source can't use is shared again by weight."""
    held = set()
    while True:
        open_ = sum(w for k, w in enumerate(weights) if k not in held)
        left = sum(sizes) * share - sum(cap * sizes[k] for k in held)
        level = left / open_ if open_ else 0
        more = {k for k, w in enumerate(weights) if k not in held and w * level > cap * sizes[k]}
        if not more:
            return [float(cap * s) if k in held else weights[k] * level for k, s in enumerate(sizes)]
        held |= more
