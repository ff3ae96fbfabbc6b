"""Dense kernels against plain definitions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from histospark.kernels import arrays as k

images = st.tuples(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**31)).map(lambda t: np.random.default_rng(t[2]).integers(0, 7, t[:2]))


def slow_reconstruction(marker, mask, connectivity):
    out = np.minimum(marker, mask)
    while True:
        wide = out.copy()
        for dy, dx in k.near(connectivity):
            wide = np.maximum(wide, k.shifted(out, dy, dx, out.min()))
        wide = np.minimum(wide, mask)
        if np.array_equal(wide, out):
            return out
        out = wide


@settings(max_examples=60, deadline=None)
@given(images, st.sampled_from([4, 8]), st.integers(0, 3))
def test_reconstructions_agree(mask, connectivity, drop):
    marker = np.maximum(mask - drop, 0) * (np.arange(mask.size).reshape(mask.shape) % 3 == 0)
    got = k.reconstruct(marker.copy(), mask, connectivity)
    assert np.array_equal(got, slow_reconstruction(marker, mask, connectivity))
    assert np.array_equal(got, k.downhill(marker, mask, connectivity))
    assert np.array_equal(k.reconstruct(got.copy(), mask, connectivity), got) and (got <= mask).all()


@settings(max_examples=60, deadline=None)
@given(images, st.sampled_from([4, 8]))
def test_labels_are_components(values, connectivity):
    values = values // 3
    got = k.label(values, connectivity)
    h, w = values.shape
    parent = list(range(h * w))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for y in range(h):
        for x in range(w):
            for dy, dx in k.near(connectivity):
                a, b = y + dy, x + dx
                if 0 <= a < h and 0 <= b < w and values[y, x] and values[a, b] == values[y, x]:
                    i, j = root(y * w + x), root(a * w + b)
                    parent[max(i, j)] = min(i, j)
    assert got.tolist() == [[root(y * w + x) if values[y, x] else -1 for x in range(w)] for y in range(h)]


@settings(max_examples=40, deadline=None)
@given(images)
def test_distances(values):
    v = values % 5
    zeros = np.argwhere(v == 0)
    if not len(zeros):
        assert (k.squared_distance(v) == -1).all()
        return
    exact = np.array([[((zeros - [y, x]) ** 2).sum(1).min() for x in range(v.shape[1])] for y in range(v.shape[0])])
    assert np.array_equal(k.squared_distance(v), exact)
    assert (k.wavefront_distance(v) >= np.sqrt(exact) - 1e-9).all()


def test_regional_maxima_of_a_plateau_beside_a_higher_one():
    v = np.array([[1, 1, 1, 0], [1, 1, 1, 2], [0, 0, 0, 2]])
    assert k.regional_maxima(v, 8).tolist() == [[False] * 4, [False, False, False, True], [False, False, False, True]]


@pytest.mark.parametrize("connectivity", [4, 8])
def test_drop_of_water_leads_to_one_minimum_each(connectivity):
    v = np.random.default_rng(3).integers(0, 30, (20, 20))
    labels = k.drop_of_water(v, connectivity)
    minima = k.regional_maxima(-v, connectivity)
    assert set(np.unique(labels)) == set(np.unique(k.label(minima.astype(int), connectivity)[minima] + 1))


def test_flood_keeps_one_marker_in_each_basin():
    colour = np.zeros((12, 12, 3), int)
    colour[:, 6:] = 200
    markers = np.zeros((12, 12), int)
    markers[5, 2], markers[5, 9] = 1, 2
    out = k.flood(colour, markers)
    assert set(np.unique(out)) == {-1, 1, 2} and (out[1:-1, 1:5] == 1).all() and (out[1:-1, 8:-1] == 2).all()


def test_canny_finds_the_edge_of_a_step():
    v = np.zeros((16, 16), int)
    v[:, 8:] = 200
    edges = k.canny(v)
    assert set(np.unique(edges)) == {0, 255} and (edges.any(axis=0).nonzero()[0]).tolist() in ([7], [8])
