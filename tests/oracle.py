"""The packing and the descent, step by step in plain Python: what the engine is tested against."""

from __future__ import annotations

import math

from tilewright.functions.geometry import f32


def slice_width(n, cap):
    groups = -(-n // cap)
    if groups <= 1:
        return n
    k = math.ceil(math.sqrt(groups))
    return -(-groups // k) * cap


def pack(level, cap, base, is_leaf):
    """Pages of one level from (box, child) pairs: sort by x, cut into slices, sort each by y, cut into pages."""
    if not is_leaf and len(level) <= cap:
        return [(base, level)]
    by_x = sorted(level, key=lambda e: (f32(e[0][0] + e[0][2]), e[1]))
    width, pages = slice_width(len(level), cap), []
    for a in range(0, len(by_x), width):
        by_y = sorted(by_x[a : a + width], key=lambda e: f32(e[0][1] + e[0][3]))
        pages += [by_y[b : b + cap] for b in range(0, len(by_y), cap)]
    return [(base + k, p) for k, p in enumerate(pages)]


def union(entries):
    return (min(e[0][0] for e in entries), min(e[0][1] for e in entries), max(e[0][2] for e in entries), max(e[0][3] for e in entries))


def build(rects, leaf_cap, internal_cap):
    """{page: (level, entries)} and the root page."""
    level, number, base, out = [(box, i) for i, box in sorted(rects.items())], 0, 1, {}
    while True:
        pages = pack(level, leaf_cap if number == 0 else internal_cap, base, number == 0)
        out.update({p: (number, entries) for p, entries in pages})
        if len(pages) == 1:
            return out, pages[0][0]
        level = [(union(entries), p) for p, entries in pages]
        base, number = base + len(pages), number + 1


def meets(a, b):
    return a[0] <= b[2] and a[2] >= b[0] and a[1] <= b[3] and a[3] >= b[1]


def descend(tree, root, box):
    """Hits and (pages_read, entries_tested, entries_pruned, results) of a recursive descent."""
    hits, read, tested, pruned, todo = [], 0, 0, 0, [root]
    while todo:
        level, entries = tree[todo.pop()]
        read += 1
        for own, child in entries:
            tested += 1
            if not meets(own, box):
                pruned += 1
            elif level:
                todo.append(child)
            else:
                hits.append(child)
    return sorted(hits), (read, tested, pruned, len(hits))
