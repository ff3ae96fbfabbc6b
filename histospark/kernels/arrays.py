"""Dense kernels over numpy arrays, for use inside Arrow functions on one tile or one image."""

from __future__ import annotations

import heapq

import numpy as np

N4 = [(-1, 0), (0, -1), (0, 1), (1, 0)]
N8 = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def near(connectivity: int) -> list[tuple[int, int]]:
    return N4 if connectivity == 4 else N8


def shifted(a: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """out[y, x] = a[y + dy, x + dx], ``fill`` outside."""
    out = np.full_like(a, fill)
    h, w = a.shape
    ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    out[ys, xs] = a[max(0, dy) : min(h, h + dy), max(0, dx) : min(w, w + dx)]
    return out


def label(values: np.ndarray, connectivity: int) -> np.ndarray:
    """The smallest linear index of each component of equal non-zero values, -1 for zeros: rounds of taking the least among
    neighbours, each followed by pointer jumping."""
    h, w = values.shape
    index = np.arange(h * w, dtype=np.int64).reshape(h, w)
    root = np.where(values != 0, index, h * w)
    same = [(dy, dx, (shifted(values, dy, dx, 0) == values) & (values != 0)) for dy, dx in near(connectivity)]
    while True:
        least = root
        for dy, dx, ok in same:
            least = np.where(ok, np.minimum(least, shifted(root, dy, dx, h * w)), least)
        flat = np.append(least.ravel(), h * w)
        while not np.array_equal(jumped := flat[flat], flat):
            flat = jumped
        least = flat[:-1].reshape(h, w)
        if np.array_equal(least, root):
            return np.where(values != 0, root, -1)
        root = least


def reconstruct(marker: np.ndarray, mask: np.ndarray, connectivity: int) -> np.ndarray:
    """Grey reconstruction by dilation: sweeps down, up, right and left, row by row and column by column, until stable."""
    out = np.minimum(marker, mask)

    def widened(line: np.ndarray) -> np.ndarray:
        if connectivity == 4 or len(line) < 2:
            return line
        wide = line.copy()
        wide[1:] = np.maximum(wide[1:], line[:-1])
        wide[:-1] = np.maximum(wide[:-1], line[1:])
        return wide

    while True:
        before = out.copy()
        for view, limit in ((out, mask), (out[::-1], mask[::-1]), (out.T, mask.T), (out.T[::-1], mask.T[::-1])):
            for k in range(1, len(view)):
                np.minimum(np.maximum(view[k], widened(view[k - 1])), limit[k], out=view[k])
        if np.array_equal(out, before):
            return out


def downhill(marker: np.ndarray, mask: np.ndarray, connectivity: int) -> np.ndarray:
    """The same reconstruction by levels from the highest down, for small non-negative integers."""
    h, w = mask.shape
    out = np.minimum(marker, mask).astype(int)
    done = np.zeros((h, w), bool)
    levels: dict[int, list[tuple[int, int]]] = {}
    for y, x in zip(*np.nonzero(out), strict=True):
        levels.setdefault(int(out[y, x]), []).append((int(y), int(x)))
    for level in range(int(out.max(initial=0)), 0, -1):
        todo = levels.get(level, [])
        while todo:
            y, x = todo.pop()
            if done[y, x] or out[y, x] != level:
                continue
            done[y, x] = True
            for dy, dx in near(connectivity):
                a, b = y + dy, x + dx
                if 0 <= a < h and 0 <= b < w and not done[a, b] and (to := min(level, int(mask[a, b]))) > out[a, b]:
                    out[a, b] = to
                    (todo if to == level else levels.setdefault(to, [])).append((a, b))
    return out


def regional_maxima(v: np.ndarray, connectivity: int) -> np.ndarray:
    """Flat zones without a higher neighbour."""
    zone = label(np.unique(v, return_inverse=True)[1].reshape(v.shape) + 1, connectivity)
    higher = np.zeros(v.shape, bool)
    for dy, dx in near(connectivity):
        higher |= shifted(v.astype(float), dy, dx, -np.inf) > v
    return ~np.isin(zone, np.unique(zone[higher]))


FAR = 1 << 40


def column_distance(v: np.ndarray) -> np.ndarray:
    """Distance of each pixel to the nearest zero of its column; FAR or more where it has none."""
    down = np.where(v == 0, 0, FAR).astype(np.int64)
    for y in range(1, len(v)):
        down[y] = np.minimum(down[y], down[y - 1] + 1)
    for y in range(len(v) - 2, -1, -1):
        down[y] = np.minimum(down[y], down[y + 1] + 1)
    return down


def nearest_in_rows(down: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distance from the distances along columns; -1 without any zero. Rows are searched for as many steps as any
    distance is long."""
    if (down >= FAR).all():
        return np.full(down.shape, -1, np.int64)
    square = np.where(down >= FAR, FAR, down * down)
    out, step, w = square.copy(), 1, down.shape[1]
    while step < w and step * step < out.max():
        out[:, step:] = np.minimum(out[:, step:], square[:, :-step] + step * step)
        out[:, :-step] = np.minimum(out[:, :-step], square[:, step:] + step * step)
        step += 1
    return out


def squared_distance(v: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distance to the nearest zero; -1 without any zero."""
    return nearest_in_rows(column_distance(np.minimum(v, 1)))


def wavefront_distance(v: np.ndarray) -> np.ndarray:
    """Distance to the nearest zero as the eight-neighbour wavefront finds it (approximate): pixels take over their neighbours'
    nearest zero while that is closer. Without zeros, the distance to the place after three images."""
    h, w = v.shape
    yy, xx = np.mgrid[0:h, 0:w]
    ny, nx = np.where(v == 0, yy, 3 * h), np.where(v == 0, xx, 0)
    if v.all():
        return np.sqrt((ny - yy) ** 2 + (nx - xx) ** 2)
    dist = np.where(v == 0, 0, 9 * (h + w) ** 2)
    while True:
        changed = False
        for dy, dx in N8:
            cy, cx = shifted(ny, dy, dx, 3 * h), shifted(nx, dy, dx, 0)
            d = (cy - yy) ** 2 + (cx - xx) ** 2
            closer = (d < dist) & (cy < h)
            if closer.any():
                ny, nx, dist, changed = np.where(closer, cy, ny), np.where(closer, cx, nx), np.where(closer, d, dist), True
        if not changed:
            return np.sqrt(dist)


def flood(colour: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """Marker watershed of a colour image (h, w, 3): pixels join the basin from which the largest difference of a channel is
    least, first come first served among equals; -1 where basins meet and on the outermost pixels."""
    h, w = markers.shape
    out = markers.astype(np.int64).copy()
    out[[0, -1], :] = -1
    out[:, [0, -1]] = -1
    img = colour.astype(np.int64)
    queue: list[tuple[int, int, int, int]] = []
    seen = out != 0
    count = 0

    def push(y: int, x: int) -> None:
        nonlocal count
        for dy, dx in N4:
            a, b = y + dy, x + dx
            if 0 < a < h - 1 and 0 < b < w - 1 and not seen[a, b]:
                seen[a, b] = True
                heapq.heappush(queue, (min(int(np.abs(img[a, b] - img[a + p, b + q]).max()) for p, q in N4 if out[a + p, b + q] > 0), count, a, b))
                count += 1

    for y, x in zip(*np.nonzero(out > 0), strict=True):
        push(int(y), int(x))
    while queue:
        _, _, y, x = heapq.heappop(queue)
        basins = {int(out[y + dy, x + dx]) for dy, dx in N4} - {0, -1}
        out[y, x] = basins.pop() if len(basins) == 1 else -1
        if out[y, x] > 0:
            push(y, x)
    out[out == 0] = -1
    return out


def drop_of_water(v: np.ndarray, connectivity: int) -> np.ndarray:
    """Each pixel's minimum by steepest descent, as the smallest linear index of that minimum plus 1. Flat zones drain to their nearest
    pixel with a lower neighbour; among equal ways the first neighbour counts."""
    h, w = v.shape
    index = np.arange(h * w).reshape(h, w)
    low, to = v.astype(float).copy(), index.copy()
    for dy, dx in near(connectivity):
        q = shifted(v.astype(float), dy, dx, np.inf)
        lower = q < low
        low, to = np.where(lower, q, low), np.where(lower, index + dy * w + dx, to)
    unset = h * w + 1
    dist = np.where(to != index, 0, unset)
    while True:
        best, way = dist.copy(), to.copy()
        for dy, dx in near(connectivity):
            closer = (shifted(v.astype(float), dy, dx, np.inf) == v) & (shifted(dist, dy, dx, unset) + 1 < best)
            best, way = np.where(closer, shifted(dist, dy, dx, unset) + 1, best), np.where(closer, index + dy * w + dx, way)
        if np.array_equal(best, dist):
            break
        dist, to = best, way
    flats = np.where(dist == unset, np.unique(v, return_inverse=True)[1].reshape(v.shape) + 1, 0)
    pools = label(flats, connectivity)
    flat = np.where(pools >= 0, pools, to).ravel()
    while not np.array_equal(jumped := flat[flat], flat):
        flat = jumped
    return flat.reshape(h, w) + 1


def cheapest_paths(v: np.ndarray, connectivity: int, rounds: int = 2000) -> np.ndarray:
    """Watershed by relaxation: pixels take the label of the neighbour through which the path to a regional minimum costs least. A step
    costs how far the higher of its two pixels is above its lowest neighbour, of equal ones the mean of both."""
    f = v.astype(float)
    lowest = f.copy()
    for dy, dx in near(connectivity):
        lowest = np.minimum(lowest, shifted(f, dy, dx, np.inf))
    rise = f - lowest
    minima = regional_maxima(-f, connectivity)
    out = np.where(minima, label(minima.astype(int), connectivity) + 1, 0)
    cost = np.where(minima, 0.0, np.inf)
    for _ in range(rounds):
        best, way = cost, out
        for dy, dx in near(connectivity):
            q = shifted(f, dy, dx, np.inf)
            step = np.where(f > q, rise, np.where(q > f, shifted(rise, dy, dx, 0), (rise + shifted(rise, dy, dx, 0)) / 2))
            total = shifted(cost, dy, dx, np.inf) + step
            closer = total < best
            best, way = np.where(closer, total, best), np.where(closer, shifted(out, dy, dx, 0), way)
        if np.array_equal(best, cost):
            break
        cost, out = best, way
    return out


def canny_marks(v: np.ndarray, low: float = 70, high: float = 90) -> tuple[np.ndarray, np.ndarray]:
    """Where edges may be (weak) and surely are (strong): ridges of the norm, the sum of absolute slopes by a 5 x 5 Sobel operator with
    replicated edges, above the bounds."""
    smooth, slope = (1, 4, 6, 4, 1), (-1, -2, 0, 2, 1)
    pad = np.pad(v.astype(np.int64), 2, mode="edge")
    h, w = v.shape
    window = lambda i, j: pad[i : i + h, j : j + w]
    gx = sum(smooth[i] * slope[j] * window(i, j) for i in range(5) for j in range(5))
    gy = sum(slope[i] * smooth[j] * window(i, j) for i in range(5) for j in range(5))
    norm = np.abs(gx) + np.abs(gy)
    ax, ay = np.abs(gx), np.abs(gy)
    flat, steep = ay < ax * np.tan(np.pi / 8), ay > ax * np.tan(3 * np.pi / 8)
    side = np.where((gx < 0) != (gy < 0), -1, 1)
    at = lambda dy, dx: shifted(norm, dy, dx, 0)
    diagonal = np.where(side == 1, (norm > at(-1, -1)) & (norm > at(1, 1)), (norm > at(-1, 1)) & (norm > at(1, -1)))
    top = np.where(flat, (norm > at(0, -1)) & (norm >= at(0, 1)), np.where(steep, (norm > at(-1, 0)) & (norm >= at(1, 0)), diagonal))
    weak = top & (norm > low)
    return weak, weak & (norm > high)


def canny(v: np.ndarray, low: float = 70, high: float = 90) -> np.ndarray:
    """Canny edges (255): weak marks that strong ones lead to."""
    weak, strong = canny_marks(v, low, high)
    return reconstruct(strong.astype(np.int64), weak.astype(np.int64), 8) * 255


def outer_filled(mask: np.ndarray) -> np.ndarray:
    """The mask with everything that background (four-connected) from outside doesn't reach."""
    framed = np.pad(~mask, 1, constant_values=True)
    start = np.zeros(framed.shape, np.int64)
    start[0, 0] = 1
    return reconstruct(start, framed.astype(np.int64), 4)[1:-1, 1:-1] == 0


def polygon_measure(mask: np.ndarray) -> tuple[float, int]:
    """Of the closed line through the centres of a filled mask's boundary pixels: its area, a half for each 2 x 2 quad with three pixels and one for each
    with four, and the number of its points, by Pick's theorem."""
    quads = mask[:-1, :-1].astype(int) + mask[:-1, 1:] + mask[1:, :-1] + mask[1:, 1:]
    area = float((quads == 4).sum() + (quads == 3).sum() / 2)
    return area, int(2 * (mask.sum() - 1 - area))


def contour_measures(mask: np.ndarray) -> tuple[int, int, float, int, int]:
    """(pixels, filled pixels, polygon area, contour points, net measure) of one component. The net measure is the rounded polygon area with half
    of the points and one, less the same of each hole, whose line goes through the pixels around it."""
    filled = outer_filled(mask)
    area, points = polygon_measure(filled)
    net = round(area) + points // 2 + 1
    holes = label(np.where(filled & ~mask, 1, 0), 4)
    for root in np.unique(holes[holes >= 0]):
        hole = np.pad(holes == root, 1)
        rim = hole.copy()
        for dy, dx in N4:
            rim |= shifted(hole, dy, dx, False)
        a, n = polygon_measure(rim)
        net -= round(a) + n // 2 + 1
    return int(mask.sum()), int(filled.sum()), area, points, net


def widened(mask: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    """What the offsets reach from the mask."""
    out = np.zeros_like(mask)
    for dy, dx in offsets:
        out |= shifted(mask, -dy, -dx, False)
    return out
