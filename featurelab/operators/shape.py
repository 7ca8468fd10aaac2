"""Structural features: each image is thinned once; its paths give strokes, transitions and curvature.

One Arrow pass per image batch runs the small numpy kernels, thinning all images of the batch at once; histograms over
the paths' steps are column expressions on the row's own paths, so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelab.functions.geometry import BINS, bound, direction_bin, turn_bin, wrapped

SIDE = 28
_AROUND = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
#: Images that a task has as numbers at once; an Arrow batch may hold 10,000.
IMAGES = 256
SHAPE = "components int, holes int, endpoints int, junctions int, paths array<array<struct<r:int,c:int>>>"


def thin(masks: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning of one image or of a stack of them: two alternating passes remove border pixels until
    nothing changes; then corners go whose only neighbours, one across and one down, touch each other diagonally."""
    m = np.pad(masks.reshape(-1, *masks.shape[-2:]).astype(np.uint8), ((0, 0), (1, 1), (1, 1)))
    live = np.arange(len(m))  # images that the last round has changed
    while len(live):
        work, removed = m[live], np.zeros(len(live), dtype=np.int64)
        for second in (False, True):
            p = [work[:, :-2, 1:-1], work[:, :-2, 2:], work[:, 1:-1, 2:], work[:, 2:, 2:], work[:, 2:, 1:-1], work[:, 2:, :-2], work[:, 1:-1, :-2], work[:, :-2, :-2]]
            count = sum(p)
            changes = sum((p[k] == 0) & (p[(k + 1) % 8] == 1) for k in range(8))
            north, east, south, west = p[0], p[2], p[4], p[6]
            sides = (north * east * west == 0) & (north * south * west == 0) if second else (north * east * south == 0) & (east * south * west == 0)
            gone = (work[:, 1:-1, 1:-1] == 1) & (count >= 2) & (count <= 6) & (changes == 1) & sides
            removed += gone.sum(axis=(1, 2))
            work[:, 1:-1, 1:-1][gone] = 0
        m[live] = work
        live = live[removed > 0]
    for k, r, c in np.argwhere(m).tolist():
        near = [(a, b) for a, b in _AROUND if m[k, r + a, c + b]]
        if len(near) == 2 and sorted(abs(a) for a, _ in near) == [0, 1] and sorted(abs(b) for _, b in near) == [0, 1]:
            m[k, r, c] = 0
    return m[:, 1:-1, 1:-1].astype(bool).reshape(masks.shape)


def skeleton(image: np.ndarray, threshold: float = 0.5) -> np.ndarray:
    """The thinned pixels of at least ``threshold``, which is finite and between 0 and 1, both included."""
    if isinstance(threshold, bool) or not 0 <= threshold <= 1:
        raise ValueError("threshold must be finite and between 0 and 1")
    if image.ndim != 2:
        raise ValueError("an image has two dimensions")
    return thin(image >= threshold)


def regions(mask: np.ndarray, diagonal: bool) -> list[set[tuple[int, int]]]:
    """Connected pixels of ``mask``, over 8 or 4 neighbours."""
    steps = _AROUND if diagonal else [s for s in _AROUND if 0 in s]
    left, out = set(map(tuple, np.argwhere(mask).tolist())), []
    while left:
        todo, found = [left.pop()], set()
        while todo:
            at = todo.pop()
            found.add(at)
            near = {(at[0] + a, at[1] + b) for a, b in steps} & left
            left -= near
            todo.extend(near)
        out.append(found)
    return out


def hole_count(mask: np.ndarray) -> int:
    """Background regions over 4 neighbours that don't touch the border."""
    h, w = mask.shape
    return sum(all(0 < r < h - 1 and 0 < c < w - 1 for r, c in region) for region in regions(~mask, diagonal=False))


Pixel = tuple[int, int]


def pixel_graph(skeleton: np.ndarray) -> dict[Pixel, set[Pixel]]:
    """Neighbours of each skeleton pixel; a diagonal counts only if both pixels at its corner are off."""
    if skeleton.ndim != 2:
        raise ValueError("a skeleton has two dimensions")
    on = set(map(tuple, np.argwhere(skeleton).tolist()))
    return {(r, c): {(r + a, c + b) for a, b in _AROUND if (r + a, c + b) in on and not (a and b and ((r + a, c) in on or (r, c + b) in on))} for r, c in on}


def junction_clusters(graph: dict[Pixel, set[Pixel]]) -> list[list[Pixel]]:
    """Connected pixels with three neighbours or more, each cluster sorted."""
    left, out = {p for p, near in graph.items() if len(near) >= 3}, []
    while left:
        todo, found = [left.pop()], []
        while todo:
            at = todo.pop()
            found.append(at)
            near = graph[at] & left
            left -= near
            todo.extend(near)
        out.append(sorted(found))
    return sorted(out)


def endpoints(graph: dict[Pixel, set[Pixel]]) -> list[Pixel]:
    return sorted(p for p, near in graph.items() if len(near) == 1)


def contracted(graph: dict[Pixel, set[Pixel]]) -> dict[Pixel, set[Pixel]]:
    """Each junction cluster as its smallest pixel; no loops or parallel edges."""
    stand = {p: cluster[0] for cluster in junction_clusters(graph) for p in cluster}
    out: dict[Pixel, set[Pixel]] = {}
    for p, near in graph.items():
        own = out.setdefault(stand.get(p, p), set())
        own |= {stand.get(q, q) for q in near} - {stand.get(p, p)}
    return out


def graph_paths(skeleton_graph: dict[Pixel, set[Pixel]]) -> list[list[Pixel]]:
    """Paths between pixels that don't have two neighbours, isolated pixels, then closed loops; sorted."""
    graph = contracted(skeleton_graph)
    used: set[frozenset[Pixel]] = set()
    out: list[list[Pixel]] = []

    def follow(start: Pixel, step: Pixel) -> list[Pixel]:
        path = [start]
        while frozenset((path[-1], step)) not in used:
            used.add(frozenset((path[-1], step)))
            path.append(step)
            if len(graph[step]) != 2:
                break
            step = next((q for q in sorted(graph[step]) if frozenset((path[-1], q)) not in used), path[-2])
        return path

    for p in sorted(p for p, near in graph.items() if len(near) != 2):
        if not graph[p]:
            out.append([p])
        out += [follow(p, q) for q in sorted(graph[p]) if frozenset((p, q)) not in used]
    for p in sorted(graph):  # what is left are loops, entered at their smallest pixel
        if len(graph[p]) == 2 and frozenset((p, min(graph[p]))) not in used:
            out.append(follow(p, min(graph[p])))
    return sorted(out)


def _by_images(returns: str, of: Callable[[np.ndarray], pa.Array]) -> Callable[[Column], Column]:
    """A function of columns of pixels by ``of``, which is given IMAGES images at most: what a task holds beside a batch
    doesn't grow with the batch."""

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for lo in range(0, max(1, len(batch)), IMAGES):
                part = batch.slice(lo, IMAGES)
                sizes = np.diff(part.offsets.to_numpy()) if len(part) else np.zeros(0)
                if part.null_count or (sizes != SIDE * SIDE).any():
                    raise ValueError("an image has 28 x 28 pixels")
                yield of(part.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, SIDE, SIDE))

    return F.arrow_udf(read, returns)


def shape_of(pixels: Column, threshold: float = 0.5) -> Column:
    """A struct: topology at ``threshold`` and the paths of the skeleton, which is always taken at 0.5."""

    def read(a: np.ndarray) -> pa.Array:
        masks, thinned = a >= threshold, thin(a >= 0.5)
        owned = thinned if threshold == 0.5 else thin(masks)
        numbers, steps, ends, paths = [], [], [0], [0]
        for mask, skeleton, own in zip(masks, thinned, owned):
            graph = pixel_graph(skeleton)
            other = graph if threshold == 0.5 else pixel_graph(own)
            for path in graph_paths(graph):
                steps += path
                ends.append(len(steps))
            paths.append(len(ends) - 1)
            numbers.append((len(regions(mask, diagonal=True)), hole_count(mask), len(endpoints(other)), len(junction_clusters(other))))
        r, c = np.array(steps, dtype=np.int32).reshape(-1, 2).T
        points = pa.StructArray.from_arrays([pa.array(r), pa.array(c)], ["r", "c"])
        lists = pa.ListArray.from_arrays(pa.array(paths, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), points))
        columns = np.array(numbers, dtype=np.int32).reshape(-1, 4).T
        return pa.StructArray.from_arrays([*map(pa.array, columns), lists], ["components", "holes", "endpoints", "junctions", "paths"])

    return _by_images(SHAPE, read)(pixels)


def shapes(images: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(image_id, components, holes, endpoints, junctions, paths) of every image."""
    return images.select("image_id", shape_of(F.col("pixels"), threshold).alias("_s")).select("image_id", "_s.*")


def topology(shape: Column) -> Column:
    return F.array(*[shape[c].cast("double") for c in ("components", "holes", "endpoints", "junctions")])


def _angles(points: Column) -> Column:
    """Angles of a path's steps."""
    steps = F.transform(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda q, i: F.atan2((q["r"] - F.get(points, i)["r"]).cast("double"), (q["c"] - F.get(points, i)["c"]).cast("double")))
    return F.when(F.size(points) > 1, steps).otherwise(F.array().cast("array<double>"))


def _pairs(points: Column) -> Column:
    """(a, b) of a path: angles of steps in succession, round the end of a closed path too."""
    closed = (F.size(points) > 2) & (F.get(points, 0) == F.element_at(points, -1))
    around = bound(_angles(points), lambda angles: F.when(closed & (F.size(angles) > 1), F.concat(angles, F.slice(angles, 1, 1))).otherwise(angles))
    return bound(around, lambda x: F.transform(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda b, i: F.struct(F.get(x, i).alias("a"), b.alias("b"))))


def _histogram(bins: Column, size: int) -> Column:
    """Shares of the bins 0 to ``size`` - 1 in an array of pairs of bins; zeros if it is empty."""
    share = lambda flat, k: F.when(F.size(flat) > 0, F.size(F.filter(flat, lambda x: x == k)) / F.size(flat)).otherwise(0.0)
    return bound(F.flatten(bins), lambda flat: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: share(flat, k)))


def direction_histogram(paths: Column) -> Column:
    """Shares of 8 directions; every step counts both ways."""
    bins = F.transform(F.flatten(F.transform(paths, _angles)), direction_bin)
    return _histogram(F.transform(bins, lambda b: F.array(b, (b + 4) % BINS)), BINS)


def transition_histogram(paths: Column) -> Column:
    """Shares of 64 pairs of directions in succession; every pair counts both ways."""
    both = F.transform(F.flatten(F.transform(paths, _pairs)), lambda p: F.struct(direction_bin(p["a"]).alias("a"), direction_bin(p["b"]).alias("b")))
    return _histogram(F.transform(both, lambda p: F.array(p["a"] * BINS + p["b"], (p["b"] + 4) % BINS * BINS + (p["a"] + 4) % BINS)), BINS * BINS)


def curvature_histogram(paths: Column) -> Column:
    """Shares of 8 turns; every turn counts both ways."""
    turns = F.transform(F.flatten(F.transform(paths, _pairs)), lambda p: wrapped(p["b"] - p["a"]))
    return _histogram(F.transform(turns, lambda t: F.array(turn_bin(t), turn_bin(-t))), BINS)


def _long(shape: DataFrame, histogram: Column) -> DataFrame:
    """(image_id, bin, share)."""
    return shape.select("image_id", F.posexplode(histogram).alias("bin", "share"))


def stroke_direction(shape: DataFrame) -> DataFrame:
    return _long(shape, direction_histogram(F.col("paths")))


def direction_transition(shape: DataFrame) -> DataFrame:
    return _long(shape, transition_histogram(F.col("paths")))


def curvature(shape: DataFrame) -> DataFrame:
    return _long(shape, curvature_histogram(F.col("paths")))


def hog_of(pixels: Column, orientations: int = 9, cell: int = 4, block: int = 2) -> Column:
    """Histogram of oriented gradients: central differences with zero borders, unsigned orientations, cell means,
    L2-Hys blocks."""
    if min(orientations, cell, block) < 1:
        raise ValueError("orientations, cell and block must be positive")

    def read(a: np.ndarray) -> pa.Array:
        gr, gc = np.zeros_like(a), np.zeros_like(a)
        gr[:, 1:-1] = a[:, 2:] - a[:, :-2]
        gc[:, :, 1:-1] = a[:, :, 2:] - a[:, :, :-2]
        size, angle = np.hypot(gr, gc), np.rad2deg(np.arctan2(gr, gc)) % 180
        n = SIDE // cell
        bins = np.minimum((angle / (180 / orientations)).astype(int), orientations - 1)
        cells = np.stack([np.where(bins == k, size, 0)[:, : n * cell, : n * cell].reshape(-1, n, cell, n, cell).mean(axis=(2, 4)) for k in range(orientations)], axis=-1)
        m = n - block + 1
        out = np.stack([cells[:, r : r + block, c : c + block].reshape(len(a), -1) for r in range(m) for c in range(m)], axis=1) if len(a) else np.zeros((0, m * m, block * block * orientations))
        eps = 1e-5
        out = np.minimum(out / np.sqrt((out**2).sum(-1, keepdims=True) + eps**2), 0.2)
        out /= np.sqrt((out**2).sum(-1, keepdims=True) + eps**2)
        return pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * (out.shape[1] * out.shape[2]), pa.array(out.ravel()))

    return _by_images("array<double>", read)(pixels)


def hog(images: DataFrame, orientations: int = 9, cell: int = 4, block: int = 2) -> DataFrame:
    """(image_id, features) of every image."""
    return images.select("image_id", hog_of(F.col("pixels"), orientations, cell, block).alias("features"))
