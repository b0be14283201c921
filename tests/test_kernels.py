"""Sequential kernels on inputs with known answers."""

import numpy as np
import pytest

from lodestone.operators import kernels as K  # noqa: N812

Y, X = np.mgrid[0:40, 0:40]
DISC = (Y - 20) ** 2 + (X - 20) ** 2 <= 81


def overlap(a, b):
    return 2 * (a & b).sum() / (a.sum() + b.sum())


def test_live_wire_follows_the_edge():
    path = K.shortest_path(K.live_wire_cost(DISC * 100.0), (20, 11), (20, 29))
    assert path[0] == (20, 11) and path[-1] == (20, 29)
    assert max(abs(np.hypot(y - 20, x - 20) - 9) for y, x in path) < 2.5


def test_eikonal_is_the_distance():
    t = K.eikonal(np.ones((30, 30)), [(0, 0)])
    assert np.allclose(t[0], np.arange(30)) and abs(t[20, 20] - np.hypot(20, 20)) < 1.5


def test_minimum_cut_finds_the_disc():
    v = DISC * 1.0
    got = K.minimum_cut(v[10:30, 10:30], 1 - v[10:30, 10:30], lambda y, x, yy, xx: 0.1)
    assert overlap(got, DISC[10:30, 10:30]) > 0.97


def test_random_walker():
    inside, outside = np.zeros_like(DISC), np.zeros_like(DISC)
    inside[20, 20] = True
    outside[0], outside[-1], outside[:, 0], outside[:, -1] = True, True, True, True
    assert overlap(K.random_walker(DISC * 1.0, inside, outside, rounds=3000) > 0.5, DISC) > 0.98


def test_level_sets():
    start = (abs(Y - 20) < 12) & (abs(X - 20) < 12)
    assert overlap(K.chan_vese(DISC * 100.0, start), DISC) > 0.95
    small = (abs(Y - 20) < 4) & (abs(X - 20) < 4)
    assert overlap(K.edge_level_set(DISC * 100.0, small), DISC) > 0.95


def test_outlines():
    assert K.diameters(np.array([(0, 0), (0, 4), (3, 0), (3, 4), (1, 1)])) == pytest.approx((5.0, 4.8))
    ring = K.traced(DISC)
    assert len(ring) > 40 and all(DISC[p] for p in ring) and (11, 20) in ring and (29, 20) in ring
    square = np.array([(5.0, 5.0), (5.0, 15.0), (15.0, 15.0), (15.0, 5.0)])
    assert K.filled(square - 0.5, 20, 20).sum() == 100
    assert K.softened(square).shape == (32, 2)
    assert K.nearest_order(np.array([(0, 0), (5, 0), (1, 0), (2, 0)])) == [0, 2, 3, 1]


def test_back_projection_and_warps():
    size = 41
    c = (size - 1) / 2
    det = np.arange(size) - c
    sino = np.tile(2 * np.sqrt(np.maximum(64 - det**2, 0)), (60, 1))
    image = K.filtered_back_projection(sino, size)
    assert image[20, 20] > 5 * abs(image[20, 2])
    moved = np.roll(DISC, 2, axis=1) * 1.0
    dy, dx = K.demons(DISC * 1.0, moved, rounds=200, alpha=0.5)
    assert np.abs(K.warped(moved, dy, dx) - DISC).mean() < 0.5 * np.abs(moved - DISC).mean()


def test_error_diffusion_keeps_the_mean():
    got = K.error_diffusion(np.full((32, 32), 0.3))
    assert set(np.unique(got)) == {0.0, 1.0} and abs(got.mean() - 0.3) < 0.02


def test_by_image(spark):
    rows = [(k, int(y), int(x), float(k + y)) for k in (1, 2) for y in range(3) for x in range(4)]
    got = K.by_image(spark.createDataFrame(rows, "img int, y int, x int, v double"), "img", lambda v: v * 2).collect()
    assert sorted((r["img"], r["y"], r["x"], r["v"]) for r in got) == sorted((k, y, x, 2 * v) for k, y, x, v in rows)
