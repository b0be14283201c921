"""Sequential kernels on one image or outline at a time, run by group.

These algorithms visit cells in an order that no set operation can express (queues, flows, iterated fields), so each image
is one Arrow batch of work, and images are spread over the cluster by their key. An image must fit into one task; larger
volumes are cut into slabs first.
"""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def by_image(cells: DataFrame, key: str, fn: Callable[[np.ndarray], np.ndarray], out: str = "v double") -> DataFrame:
    """Applies fn to each image (cells: key, y, x, v) and gives all cells of the array that it returns."""
    kind = dict(cells.dtypes)[key]
    name = out.split(" ")[0]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1))
        grid[pdf["y"].to_numpy(int), pdf["x"].to_numpy(int)] = pdf["v"].to_numpy(float)
        got = np.asarray(fn(grid))
        y, x = np.indices(got.shape)
        return pd.DataFrame({key: pdf[key].iloc[0], "y": y.ravel(), "x": x.ravel(), name: got.ravel()})

    return cells.groupBy(key).applyInPandas(run, f"{key} {kind}, y int, x int, {out}")


def gradient(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(v, 1, mode="edge")
    return (p[2:, 1:-1] - p[:-2, 1:-1]) / 2, (p[1:-1, 2:] - p[1:-1, :-2]) / 2


def laplacian(v: np.ndarray) -> np.ndarray:
    p = np.pad(v, 1, mode="edge")
    return p[2:, 1:-1] + p[:-2, 1:-1] + p[1:-1, 2:] + p[1:-1, :-2] - 4 * v


def blurred(v: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, math.ceil(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    for axis in (0, 1):
        v = np.apply_along_axis(lambda row: np.convolve(np.pad(row, r, mode="edge"), k, "valid"), axis, v)
    return v


def shortest_path(cost: np.ndarray, start: tuple[int, int], goal: tuple[int, int]) -> list[tuple[int, int]]:
    """Cheapest 8-connected way over cells; a step costs its length times the mean of both cells."""
    best, came, heap = {start: 0.0}, {}, [(0.0, start)]
    while heap:
        d, at = heapq.heappop(heap)
        if at == goal:
            break
        if d > best[at]:
            continue
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                to = (at[0] + dy, at[1] + dx)
                if (dy or dx) and 0 <= to[0] < cost.shape[0] and 0 <= to[1] < cost.shape[1]:
                    n = d + math.hypot(dy, dx) * (cost[at] + cost[to]) / 2
                    if n < best.get(to, math.inf):
                        best[to], came[to] = n, at
                        heapq.heappush(heap, (n, to))
    path = [goal]
    while path[-1] != start:
        path.append(came[path[-1]])
    return path[::-1]


def live_wire_cost(v: np.ndarray) -> np.ndarray:
    """Cheap along strong edges."""
    g = np.hypot(*gradient(v))
    return 1 / (1 + 10 * g / max(g.max(), 1e-12))


def eikonal(speed: np.ndarray, sources: list[tuple[int, int]]) -> np.ndarray:
    """Arrival times of a front from the sources, by fast marching with the upwind scheme."""
    t = np.full(speed.shape, np.inf)
    done, heap = np.zeros(speed.shape, bool), []
    for s in sources:
        t[s] = 0.0
        heapq.heappush(heap, (0.0, s))
    while heap:
        _, at = heapq.heappop(heap)
        if done[at]:
            continue
        done[at] = True
        for dy, dx in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            y, x = at[0] + dy, at[1] + dx
            if 0 <= y < t.shape[0] and 0 <= x < t.shape[1] and not done[y, x] and speed[y, x] > 0:
                a = min(t[y - 1, x] if y else np.inf, t[y + 1, x] if y + 1 < t.shape[0] else np.inf)
                b = min(t[y, x - 1] if x else np.inf, t[y, x + 1] if x + 1 < t.shape[1] else np.inf)
                step = 1 / speed[y, x]
                lo, hi = min(a, b), max(a, b)
                new = lo + step if hi - lo >= step else (lo + hi + math.sqrt(2 * step * step - (hi - lo) ** 2)) / 2
                if new < t[y, x]:
                    t[y, x] = new
                    heapq.heappush(heap, (new, (y, x)))
    return t


def minimum_cut(source: np.ndarray, sink: np.ndarray, link: Callable[[int, int, int, int], float]) -> np.ndarray:
    """Cells on the source's side of the smallest cut; capacities to the source, to the sink and between 4-neighbours (breadth-first augmenting paths)."""
    h, w = source.shape
    n, s, t = h * w, h * w, h * w + 1
    flow: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for i in range(n):
        y, x = divmod(i, w)
        flow[s][i], flow[i][t] = float(source[y, x]), float(sink[y, x])
        flow[i].setdefault(s, 0.0)
        flow[t][i] = 0.0
        for yy, xx in ((y, x + 1), (y + 1, x)):
            if yy < h and xx < w:
                c = link(y, x, yy, xx)
                flow[i][yy * w + xx] = flow[yy * w + xx][i] = c
    while True:
        came, queue = {s: s}, deque([s])
        while queue and t not in came:
            at = queue.popleft()
            for to, c in flow[at].items():
                if c > 1e-12 and to not in came:
                    came[to] = at
                    queue.append(to)
        if t not in came:
            return np.array([i in came for i in range(n)]).reshape(h, w)
        path, at = [], t
        while at != s:
            path.append((came[at], at))
            at = came[at]
        least = min(flow[a][b] for a, b in path)
        for a, b in path:
            flow[a][b] -= least
            flow[b][a] += least


def random_walker(v: np.ndarray, inside: np.ndarray, outside: np.ndarray, beta: float = 90.0, rounds: int = 500, tolerance: float = 1e-5) -> np.ndarray:
    """Probability that a walk from each cell meets the inside seeds first; Jacobi rounds towards the harmonic solution."""
    scale = max(np.ptp(v), 1e-12)
    edge = lambda a, b: np.exp(-beta * ((a - b) / scale) ** 2) + 1e-9
    down, right = edge(v[1:], v[:-1]), edge(v[:, 1:], v[:, :-1])
    p = np.where(inside, 1.0, np.where(outside, 0.0, 0.5))
    free = ~(inside | outside)
    weight = np.zeros_like(v)
    weight[:-1] += down
    weight[1:] += down
    weight[:, :-1] += right
    weight[:, 1:] += right
    for _ in range(rounds):
        total = np.zeros_like(v)
        total[:-1] += down * p[1:]
        total[1:] += down * p[:-1]
        total[:, :-1] += right * p[:, 1:]
        total[:, 1:] += right * p[:, :-1]
        new = np.where(free, total / weight, p)
        if np.abs(new - p).max() < tolerance:
            return new
        p = new
    return p


def chan_vese(v: np.ndarray, start: np.ndarray, rounds: int = 300, mu: float = 0.2, l1: float = 1.0, l2: float = 1.0) -> np.ndarray:
    """Region-based level set from a start mask; gives the mask of the inside."""
    phi = np.where(start, 1.0, -1.0)
    v = (v - v.min()) / max(np.ptp(v), 1e-12)
    for _ in range(rounds):
        inside = phi > 0
        if inside.all() or not inside.any():
            break
        c1, c2 = v[inside].mean(), v[~inside].mean()
        gy, gx = gradient(phi)
        length = np.sqrt(gx * gx + gy * gy + 1e-8)
        curvature = gradient(gy / length)[0] + gradient(gx / length)[1]
        force = mu * curvature - l1 * (v - c1) ** 2 + l2 * (v - c2) ** 2
        phi = np.clip(phi + 0.45 * force / max(np.abs(force).max(), 1e-12), -1.2, 1.2)
    return phi > 0


def edge_level_set(v: np.ndarray, start: np.ndarray, rounds: int = 300, mu: float = 0.04, length: float = 5.0, balloon: float = -3.0, step: float = 5.0, width: float = 1.5) -> np.ndarray:
    """Distance-regularised level set that stops at edges; phi is negative inside."""
    g = 1 / (1 + sum(x * x for x in gradient(blurred(v, 1.5))))
    gy, gx = gradient(g)
    phi = np.where(start, -2.0, 2.0)
    for _ in range(rounds):
        py, px = gradient(phi)
        s = np.sqrt(px * px + py * py) + 1e-10
        ny, nx = py / s, px / s
        curvature = gradient(ny)[0] + gradient(nx)[1]
        delta = np.where(np.abs(phi) <= width, (1 + np.cos(np.pi * phi / width)) / (2 * width), 0.0)
        double_well = np.where(s <= 1, np.sin(2 * np.pi * s) / (2 * np.pi), s - 1) / s
        regular = gradient(double_well * py)[0] + gradient(double_well * px)[1]
        phi = phi + step * (mu / step * regular + length * delta * (gy * ny + gx * nx + g * curvature) + balloon * delta * g)
    return phi < 0


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise."""
    pts = sorted(map(tuple, np.unique(points, axis=0).tolist()))
    if len(pts) < 3:
        return np.array(pts)

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def diameters(points: np.ndarray) -> tuple[float, float]:
    """Longest distance between points and the extent perpendicular to it."""
    h = hull(points).astype(float)
    if len(h) < 2:
        return 0.0, 0.0
    d = np.linalg.norm(h[:, None] - h[None], axis=2)
    i, j = np.unravel_index(np.argmax(d), d.shape)
    along = (h[j] - h[i]) / max(d[i, j], 1e-12)
    return float(d[i, j]), float(np.ptp(h @ np.array([-along[1], along[0]])))


def traced(mask: np.ndarray) -> list[tuple[int, int]]:
    """The outer boundary of the first component in scan order, by Moore tracing, as (y, x)."""
    cells = np.argwhere(mask)
    if not len(cells):
        return []
    ring = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
    start = tuple(map(int, cells[0]))
    at, back, out = start, 7, [start]
    on = lambda p: 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p]
    first = None
    while True:
        for k in range(1, 9):
            i = (back + k) % 8
            to = (at[0] + ring[i][0], at[1] + ring[i][1])
            if on(to):
                before = ring[(i - 1) % 8]
                empty = (at[0] + before[0], at[1] + before[1])
                break
        else:
            return out
        if at == start and (first is None or to == first):
            if first is not None:
                return out[:-1]
            first = to
        at, back = to, ring.index((empty[0] - to[0], empty[1] - to[1]))
        out.append(at)


def filtered_back_projection(sinogram: np.ndarray, size: int, legacy: bool = False) -> np.ndarray:
    """Image of a sinogram (angle, detector): ramp filter by FFT, then linear back-projection. `legacy` uses the centred ramp on an unshifted transform, which some programs do."""
    angles, dets = sinogram.shape
    n = 1 << max(1, math.ceil(math.log2(2 * dets)))
    k = np.arange(n)
    ramp = np.abs(k - n / 2) / (n / 2) if legacy else np.minimum(k, n - k) / (n / 2)
    rows = np.fft.ifft(np.fft.fft(sinogram, n, axis=1) * ramp, axis=1).real[:, :dets]
    c = (size - 1) / 2
    y, x = np.mgrid[0:size, 0:size] - c
    out = np.zeros((size, size))
    for a in range(angles):
        t = a * math.pi / angles
        at = x * math.cos(t) + y * math.sin(t) + (dets - 1) / 2
        out += np.interp(at.ravel(), np.arange(dets), rows[a], left=0, right=0).reshape(size, size)
    return out * math.pi / angles


def demons(fixed: np.ndarray, moving: np.ndarray, rounds: int = 60, alpha: float = 1.0, sigma: float = 2.0, step: float = 0.4) -> tuple[np.ndarray, np.ndarray]:
    """Displacements (dy, dx) that warp moving onto fixed."""
    dy = dx = np.zeros_like(fixed)
    gy, gx = gradient(fixed)
    for _ in range(rounds):
        d = warped(moving, dy, dx) - fixed
        size = gy * gy + gx * gx + alpha * alpha * d * d + 1e-12
        dy, dx = (blurred(f - step * blurred(d * g / size, sigma), sigma) for f, g in ((dy, gy), (dx, gx)))
    return dy, dx


def warped(v: np.ndarray, dy: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """v at displaced places, bilinear, the border repeated."""
    y, x = np.indices(v.shape)
    py, px = np.clip(y + dy, 0, v.shape[0] - 1), np.clip(x + dx, 0, v.shape[1] - 1)
    y0, x0 = np.minimum(py.astype(int), v.shape[0] - 2), np.minimum(px.astype(int), v.shape[1] - 2)
    fy, fx = py - y0, px - x0
    return (v[y0, x0] * (1 - fx) + v[y0, x0 + 1] * fx) * (1 - fy) + (v[y0 + 1, x0] * (1 - fx) + v[y0 + 1, x0 + 1] * fx) * fy


def error_diffusion(v: np.ndarray, levels: int = 2) -> np.ndarray:
    """Quantised image with the error passed on right and down by 7, 3, 5 and 1 sixteenths."""
    out = v.astype(float).copy()
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            old = out[y, x]
            out[y, x] = new = round(min(max(old, 0.0), 1.0) * (levels - 1)) / (levels - 1)
            for yy, xx, share in ((y, x + 1, 7), (y + 1, x - 1, 3), (y + 1, x, 5), (y + 1, x + 1, 1)):
                if yy < out.shape[0] and 0 <= xx < out.shape[1]:
                    out[yy, xx] += (old - new) * share / 16
    return out


def filled(outline: np.ndarray, height: int, width: int) -> np.ndarray:
    """Cells whose centre lies inside a closed outline of (y, x), even-odd."""
    y, x = np.indices((height, width))
    inside = np.zeros((height, width), bool)
    for (ay, ax), (by, bx) in zip(outline, np.roll(outline, -1, axis=0), strict=True):
        if ay != by:
            inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return inside


def softened(outline: np.ndarray, rounds: int = 3) -> np.ndarray:
    """A closed outline with midpoints put in and smoothed by quarters, again and again."""
    for _ in range(rounds):
        dense = np.empty((2 * len(outline), 2))
        dense[::2], dense[1::2] = outline, (outline + np.roll(outline, -1, axis=0)) / 2
        outline = (np.roll(dense, 1, axis=0) + 2 * dense + np.roll(dense, -1, axis=0)) / 4
    return outline


def nearest_order(points: np.ndarray) -> list[int]:
    """Visiting order that always goes to the nearest point left."""
    left, at, out = set(range(1, len(points))), 0, [0] if len(points) else []
    while left:
        at = min(left, key=lambda j: (float(np.hypot(*(points[j] - points[at]))), j))
        left.discard(at)
        out.append(at)
    return out
