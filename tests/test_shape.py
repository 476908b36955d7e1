import pytest

from tilewright.functions import geometry as G
from tilewright.functions import shape

from .oracle import slice_width


@pytest.mark.parametrize(("fill", "cap"), [(1.0, 170), (0.9, 152), (0.7, 118), (0.5, 85), (0.25, 42), (0.03, 5), (0.001, 2)])
def test_capacity_rounds_in_float32(fill, cap):
    assert shape.capacity(fill) == cap


@pytest.mark.parametrize("fill", [0, -1, 1.01, float("nan")])
def test_factors_out_of_range(fill):
    with pytest.raises(ValueError):
        shape.capacity(fill)


@pytest.mark.parametrize(("n", "leaf", "internal", "pages"), [
    (1_000_000, 170, 170, [5883, 35, 1]), (1_000_000, 118, 118, [8475, 72, 1]), (1_000_000, 85, 170, [11765, 70, 1]), (1_000_000, 42, 42, [23810, 567, 14, 1]),
    (300_000_000, 170, 170, [1764706, 10381, 62, 1]), (60, 5, 5, [12, 3, 1]), (1, 170, 170, [1]), (170, 170, 170, [1]), (171, 170, 170, [2, 1]),
])
def test_levels(n, leaf, internal, pages):
    assert shape.level_pages(n, leaf, internal) == pages
    assert shape.num_nodes(n, leaf, internal) == sum(pages) and shape.height(n, leaf, internal) == len(pages)


def test_slices_hold_whole_pages():
    for n in (1, 2, 5, 59, 60, 61, 1000, 15_000):
        for cap in (2, 5, 8, 170):
            assert shape.slice_width(n, cap) == slice_width(n, cap)
            assert n <= cap or shape.slice_width(n, cap) % cap == 0
    with pytest.raises(ValueError):
        shape.level_pages(0, 170, 170)


def test_human_bytes():
    assert [G.human_bytes(n) for n in (0, 1023, 1536, 7.2e9)] == ["0 B", "1023 B", "1.50 KB", "6.71 GB"]
