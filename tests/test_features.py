"""Feature operators on hand-made images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelab.operators import pixels, shape
from featurelab.plans.compiler import CompilationError, FeaturePipeline, OperatorSpec, RepresentationSpec, compile_spec, seed_specs


def blank():
    return np.zeros((28, 28))


def frame(spark, *images):
    return spark.createDataFrame([(i, i % 2, a.ravel().tolist()) for i, a in enumerate(images)], "image_id bigint, label int, pixels array<double>")


def values(df, column):
    return [r[0] for r in df.orderBy("image_id").select(column).collect()]


def test_pixels(spark):
    a = np.linspace(0, 1, 784).reshape(28, 28)
    df = frame(spark, a)
    assert np.allclose(values(df, pixels.raw_pixels(F.col("pixels")))[0], a.ravel())
    assert np.allclose(values(df, pixels.downsampled(F.col("pixels")))[0], a.reshape(14, 2, 14, 2).mean(axis=(1, 3)).ravel())


@pytest.mark.parametrize("bad", [-0.1, 1.1, float("nan")])
def test_bad_images_are_rejected(spark, bad):
    a = blank()
    a[3, 3] = bad
    df = frame(spark, a)
    assert values(df, pixels.is_image(F.col("pixels"))) == [False]
    with pytest.raises(Exception, match="28 x 28"):
        df.select(pixels.checked(F.col("pixels"))).collect()


def drawing(*rows, top=0, left=0):
    """An image with the characters of ``rows`` other than blanks set."""
    a = blank()
    for r, row in enumerate(rows):
        for c, x in enumerate(row):
            if x != " ":
                a[top + r, left + c] = 1
    return a


def test_ink_in_bands(spark):
    corners = blank()
    for r, c, v in ((8, 27, 0.2), (9, 3, 0.5), (18, 20, 0.3), (19, 0, 0.6), (27, 27, 0.4)):  # rows at the bands' edges
        corners[r, c] = v
    got = values(pixels_of(spark, pixels.spatial, corners, blank()), "x")
    assert np.allclose(got, [[0.1, 0.4, 0.5], [0, 0, 0]])


def pixels_of(spark, operator, *images):
    return frame(spark, *images).select("image_id", operator(F.col("pixels")).alias("x"))


def test_mirror_images(spark):
    slope = drawing("x", " x", "  x", top=2, left=4)  # no pixel meets its mirror image
    band = blank()
    band[11:17] = 0.7  # the middle six rows
    half = blank()
    half[13:15, :7] = 1  # one of two halves of the middle rows' outer quarters
    got = values(pixels_of(spark, pixels.symmetry, slope, band, half, blank()), "x")
    assert np.allclose(got, [[0, 0], [1, 1], [0, 1], [1, 1]])


def test_components_and_holes(spark):
    eight = drawing("xxx", "x x", "xxx", "x x", "xxx", top=3, left=3)
    touching = drawing("xx  ", "xx  ", "  xx", "  xx", top=20, left=20)  # one component over a corner
    open_ring = drawing("xxx", "x  ", "xxx", top=14, left=5)
    leak = drawing(" x ", "x x", " x ", top=4, left=20)  # over corners only: closed for 4 neighbours
    faint = blank()
    faint[5, 5:9] = 0.4
    images = [eight + touching + open_ring, leak, blank(), faint]
    got = {r.image_id: r for r in shape.shapes(frame(spark, *images)).collect()}
    assert [(got[k].components, got[k].holes) for k in range(4)] == [(3, 2), (1, 1), (0, 0), (0, 0)]
    low = {r.image_id: r for r in shape.shapes(frame(spark, *images), 0.4).collect()}
    assert (low[3].components, low[3].endpoints, low[3].paths) == (1, 2, [])  # paths are always taken at 0.5


def mask(*rows):
    return np.array([[x != " " for x in row] for row in rows])


def test_skeletons_by_hand():
    for before, after in (
        # a thin line stays, a thin corner gives way to a diagonal step
        (("       ", " xxxxx ", "       "), ("       ", " xxxxx ", "       ")),
        (("      ", " xxxx ", "    x ", "    x ", "      "), ("      ", " xxx  ", "    x ", "    x ", "      ")),
        # each pixel of a square of two by two has three neighbours in a row and none on two sides, so that the first pass
        # takes all; one of three by three loses its corners, its right and lower sides, then the others
        (("    ", " xx ", " xx ", "    "), ("    ", "    ", "    ", "    ")),
        (("     ", " xxx ", " xxx ", " xxx ", "     "), ("     ", "     ", "  x  ", "     ", "     ")),
        # a bar of three rows becomes its middle row, shorter at both ends
        (("         ", " xxxxxxx ", " xxxxxxx ", " xxxxxxx ", "         "), ("         ", "         ", "  xxxxx  ", "         ", "         ")),
    ):
        got = shape.thin(mask(*before))
        if len(after[0]) == 9:  # its ends may go one pixel further
            assert got[2].sum() >= 4 and got.sum() == got[2].sum()
        else:
            assert (got == mask(*after)).all()
    stack = np.stack([mask("     ", " xxx ", " xxx ", " xxx ", "     "), mask("     ", " xxx ", "     ", "   x ", "     "), np.zeros((5, 5), dtype=bool)])
    assert (shape.thin(stack) == np.stack([shape.thin(a) for a in stack])).all()
    for bad in (-0.1, 1.1, float("nan"), True):
        with pytest.raises(ValueError):
            shape.skeleton(blank(), bad)
    assert shape.skeleton(blank(), 1.0).sum() == 0 and shape.skeleton(blank() + 1, 0).sum() < 784
    with pytest.raises(ValueError):
        shape.skeleton(np.zeros(784))
    with pytest.raises(ValueError):
        shape.pixel_graph(np.zeros(784, dtype=bool))


def test_graphs_by_hand():
    stairs = shape.pixel_graph(mask("x   ", "xx  ", " xx ", "   x"))
    # the step from (0, 0) to (1, 1) goes over (1, 0), that from (2, 2) to (3, 3) is diagonal
    assert stairs[(0, 0)] == {(1, 0)} and stairs[(1, 1)] == {(1, 0), (2, 1)} and stairs[(2, 2)] == {(2, 1), (3, 3)}
    assert shape.endpoints(stairs) == [(0, 0), (3, 3)] and shape.graph_paths(stairs) == [[(0, 0), (1, 0), (1, 1), (2, 1), (2, 2), (3, 3)]]
    cross = shape.pixel_graph(mask("  x  ", "  x  ", "xxxxx", "  x  "))
    assert shape.endpoints(cross) == [(0, 2), (2, 0), (2, 4), (3, 2)] and shape.junction_clusters(cross) == [[(2, 2)]]
    # paths begin at the smaller end and are in order
    assert shape.graph_paths(cross) == [[(0, 2), (1, 2), (2, 2)], [(2, 0), (2, 1), (2, 2)], [(2, 2), (2, 3), (2, 4)], [(2, 2), (3, 2)]]
    # two junctions side by side are one cluster, for which its smallest pixel stands
    double = shape.pixel_graph(mask(" x  ", "xxxx", "  x "))
    assert shape.junction_clusters(double) == [[(1, 1), (1, 2)]] and shape.contracted(double)[(1, 1)] == {(0, 1), (1, 0), (1, 3), (2, 2)}
    diamond = shape.pixel_graph(mask("  x  ", " x x ", "x   x", " x x ", "  x  "))
    (loop,) = shape.graph_paths(diamond)
    assert len(loop) == 9 and loop[0] == loop[-1] == (0, 2) and set(loop) == set(diamond)
    assert shape.graph_paths(shape.pixel_graph(mask("x  ", "   ", "  x"))) == [[(0, 0)], [(2, 2)]]


def shares(df, i):
    return {r.bin: r.share for r in df.filter(F.col("image_id") == i).collect() if r.share}


def test_histograms_by_hand(spark):
    slope = drawing(*[" " * k + "x" for k in range(6)], top=9, left=9)
    loop = drawing("   x   ", "  x x  ", " x   x ", "x     x", " x   x ", "  x x  ", "   x   ", top=8, left=8)
    zigzag = drawing("x   x   x", " x x x x ", "  x   x  ", top=10, left=5)
    s = shape.shapes(frame(spark, slope, loop, zigzag, blank())).persist()
    # five steps down to the right, and as many back; no turn
    assert shares(shape.stroke_direction(s), 0) == {1: 0.5, 5: 0.5} and shares(shape.curvature(s), 0) == {4: 1.0}
    assert shares(shape.direction_transition(s), 0) == {1 * 8 + 1: 0.5, 5 * 8 + 5: 0.5}
    # twelve steps round the diamond, three a side; four right turns, the last at its start
    assert shares(shape.stroke_direction(s), 1) == {1: 0.25, 3: 0.25, 5: 0.25, 7: 0.25}
    c = shares(shape.curvature(s), 1)
    assert c.keys() == {2, 4, 6} and abs(c[4] - 8 / 12) < 1e-9 and abs(c[2] - 2 / 12) < 1e-9 and abs(c[6] - 2 / 12) < 1e-9
    t = shares(shape.direction_transition(s), 1)
    assert abs(sum(t.values()) - 1) < 1e-9 and sum(v for k, v in t.items() if k // 8 != k % 8) - 4 / 12 < 1e-9
    # down, down, up, up, down, down, up, up: turns of a right angle to both sides
    assert shares(shape.stroke_direction(s), 2) == {1: 0.25, 3: 0.25, 5: 0.25, 7: 0.25}
    c = shares(shape.curvature(s), 2)
    assert abs(c[4] - 4 / 7) < 1e-9 and abs(c[2] - c[6]) < 1e-9
    for f, n in ((shape.stroke_direction, 8), (shape.direction_transition, 64), (shape.curvature, 8)):
        assert f(s).filter("image_id = 3").count() == n and not shares(f(s), 3)


def test_bins_of_all_pairs_of_unit_steps(spark):
    from featurelab.functions.geometry import direction_bin, turn_bin, wrapped

    steps = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]
    a, b = F.atan2(F.col("r").cast("double"), F.col("c").cast("double")), F.atan2(F.col("s").cast("double"), F.col("d").cast("double"))
    df = spark.createDataFrame([(*x, *y) for x in steps for y in steps], "r int, c int, s int, d int")
    turn = wrapped(b - a)
    got = {tuple(row)[:4]: tuple(row)[4:] for row in df.select("r", "c", "s", "d", direction_bin(a), turn_bin(turn), turn_bin(-turn)).collect()}
    for x in steps:
        for y in steps:
            p, q = np.arctan2(*map(float, x)), np.arctan2(*map(float, y))
            w = (q - p + np.pi) % (2 * np.pi) - np.pi
            want = [int(np.floor(v * 8 / (2 * np.pi))) % 8 for v in (p % (2 * np.pi), w + np.pi, -w + np.pi)]
            assert got[(*x, *y)] == tuple(want), (x, y)
    # a multiple of 45 degrees belongs to the bin that it opens
    assert [got[(*x, *x)][0] for x in ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))] == list(range(8))


def test_hog(spark):
    a = blank()
    a[5:23, 12:16] = 1
    (x,) = values(shape.hog(frame(spark, a)), "features")
    assert len(x) == 1296 and np.isfinite(x).all() and max(x) > 0


def test_pipeline(spark):
    p = FeaturePipeline([OperatorSpec("spatial"), OperatorSpec("topology"), OperatorSpec("curvature"), OperatorSpec("symmetry")])
    assert p.feature_dim == 17
    a = blank()
    a[5:23, 10:18] = 1
    assert [len(x) for x in values(p.transform(frame(spark, a, blank())), "features")] == [17, 17]
    assert p.transform(frame(spark, a).limit(0)).count() == 0
    plan = p.transform(frame(spark, a))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
    for bad in ([OperatorSpec("hog")], [OperatorSpec("spatial", {"x": 1})], [OperatorSpec("topology", {"threshold": True})], []):
        with pytest.raises(CompilationError):
            FeaturePipeline(bad)


def test_specifications():
    one, two = OperatorSpec("spatial"), OperatorSpec("topology", {"threshold": 0.4})
    a = RepresentationSpec("a", "h", (one, two), "p", "f")
    b = RepresentationSpec("b", "h", (two, one), "p", "f")
    assert a.spec_hash() != b.spec_hash() and a.representation_hash() == b.representation_hash()
    assert RepresentationSpec.from_json(a.to_json()) == a
    for bad in ('{"name": "a"}', a.to_json().replace('"name":"a"', '"name":" "'), a.to_json().replace('"prediction"', '"more"')):
        with pytest.raises(ValueError):
            RepresentationSpec.from_json(bad)
    with pytest.raises(CompilationError, match="cannot compile"):
        compile_spec(RepresentationSpec("x", "h", (OperatorSpec("nope"),), "p", "f"))
    assert [compile_spec(s).feature_dim for s in seed_specs()] == [784, 4, 7, 12, 20]
