"""Closed-form shape of a packed tree: capacities, pages of each level, slice widths. Pure Python on the driver."""

from __future__ import annotations

import math

from .geometry import f32

# Fixed values of the page format: bytes of a page, of its header and of an entry; the mark of a tree file.
PAGE_BYTES, HEADER_BYTES, ENTRY_BYTES = 4096, 8, 24
MAGIC = 0x32525452
MAX_ENTRIES = (PAGE_BYTES - HEADER_BYTES) // ENTRY_BYTES


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def capacity(fill: float, most: int = MAX_ENTRIES) -> int:
    """Entries of a page at a fill factor in (0, 1]; the factor is a float32, its product a double, and at least two entries fit."""
    if not 0 < fill <= 1:
        raise ValueError(f"a fill factor lies in (0, 1]: {fill}")
    return min(most, max(2, int(f32(fill) * most)))


def slice_width(n: int, cap: int) -> int:
    """Rows of a vertical slice: a whole number of pages, about as many slices as pages in one."""
    groups = ceil_div(n, cap)
    if groups <= 1:
        return n
    k = math.isqrt(groups)
    k += k * k < groups
    return ceil_div(groups, k) * cap


def level_pages(n: int, leaf_cap: int, internal_cap: int) -> list[int]:
    """Pages of each level, leaves first, root last."""
    if n <= 0:
        raise ValueError("empty input")
    pages = [ceil_div(n, leaf_cap)]
    while pages[-1] > 1:
        pages.append(ceil_div(pages[-1], internal_cap))
    return pages


def num_nodes(n: int, leaf_cap: int, internal_cap: int) -> int:
    return sum(level_pages(n, leaf_cap, internal_cap))


def height(n: int, leaf_cap: int, internal_cap: int) -> int:
    return len(level_pages(n, leaf_cap, internal_cap))
