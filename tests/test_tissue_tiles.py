import numpy as np
import pytest
from pyspark.sql import functions as F

from bagspark.operators import tiles as T
from bagspark.operators import tissue as Ti
from bagspark.plans.tiling import build_tiles


def spiral(n):
    grid = np.zeros((n, n), bool)
    y = x = 0
    dy, dx = 0, 1
    grid[0, 0] = True
    for _ in range(n * n):
        ny, nx = y + dy, x + dx
        ahead = (ny + dy, nx + dx)
        blocked = not (0 <= ny < n and 0 <= nx < n) or (0 <= ahead[0] < n and 0 <= ahead[1] < n and grid[ahead])
        if blocked:
            dy, dx = dx, -dy
            ny, nx = y + dy, x + dx
            ahead = (ny + dy, nx + dx)
            if not (0 <= ny < n and 0 <= nx < n) or grid[ny, nx] or (0 <= ahead[0] < n and 0 <= ahead[1] < n and grid[ahead]):
                break
        y, x = ny, nx
        grid[y, x] = True
    return grid


def flood(grid):
    """Labels by relaxation: every cell takes the least number among itself and its neighbours until nothing moves."""
    big = grid.size + 1
    value = np.where(grid, np.arange(1, grid.size + 1).reshape(grid.shape), big)
    while True:
        framed = np.pad(value, 1, constant_values=big)
        least = np.minimum.reduce([value, framed[:-2, 1:-1], framed[2:, 1:-1], framed[1:-1, :-2], framed[1:-1, 2:]])
        least = np.where(grid, least, big)
        if (least == value).all():
            return np.where(grid, value, 0)
        value = least


def masks():
    rng = np.random.default_rng(0)
    board = np.indices((12, 12)).sum(0) % 2 == 0
    blob = np.zeros((20, 20), bool)
    blob[3:17, 5:9] = True
    return {0: spiral(25), 1: board, 2: blob, 3: rng.random((30, 30)) < 0.55, 4: rng.random((30, 30)) < 0.62}


@pytest.mark.parametrize("block", [4, 128])
def test_components_match_flood_fill(spark, block):
    data = [(s, int(y), int(x)) for s, g in masks().items() for y, x in zip(*np.nonzero(g))]
    pixels, roots = Ti.connected_components(spark.createDataFrame(data, "slide_id bigint, y int, x int"), block)
    root = {(r["slide_id"], r["comp"]): r["root"] for r in roots.collect()}
    got = {(r["slide_id"], r["y"], r["x"]): root[r["slide_id"], r["comp"]] for r in pixels.collect()}
    assert len(got) == len(data)
    for s, g in masks().items():
        want = flood(g)
        pairs = {(want[y, x], got[s, y, x]) for y, x in zip(*np.nonzero(g))}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}), s


def test_no_pixels_no_components(spark):
    pixels, roots = Ti.connected_components(spark.createDataFrame([], "slide_id bigint, y int, x int"))
    assert pixels.count() == 0 and roots.count() == 0


def test_hsv_matches_colorsys(spark):
    import colorsys

    rng = np.random.default_rng(1)
    rgb = np.vstack([rng.integers(0, 256, (60, 3)), [[0, 0, 0], [255, 255, 255], [9, 9, 9], [200, 200, 10], [10, 200, 200]]])
    df = spark.createDataFrame([(i, 0, 0, *map(int, c)) for i, c in enumerate(rgb)], "slide_id bigint, y int, x int, r int, g int, b int")
    for r in Ti.rgb_to_hsv(df).collect():
        h, s, v = colorsys.rgb_to_hsv(*(rgb[r["slide_id"]] / 255))
        assert np.isclose(r["sat"], s) and np.isclose(r["val"], v) and np.isclose(r["hue"] % 1.0, h % 1.0)


def numpy_otsu(v):
    hist, edges = np.histogram(v, bins=256)
    c = (edges[1:] + edges[:-1]) / 2
    w0, m0 = np.cumsum(hist), np.cumsum(hist * c)
    ok = (w0 > 0) & (w0 < w0[-1])
    if not ok.any():
        return c[128]
    with np.errstate(all="ignore"):
        score = w0 * (w0[-1] - w0) * (m0 / w0 - (m0[-1] - m0) / (w0[-1] - w0)) ** 2
    return c[np.argmax(np.where(ok, score, -np.inf))]


def test_otsu_matches_numpy(spark):
    rng = np.random.default_rng(2)
    data = {0: np.r_[rng.normal(0.2, 0.03, 300), rng.normal(0.7, 0.05, 200)], 1: rng.random(50), 2: np.full(20, 0.4), 3: np.array([0.1, 0.9])}
    df = spark.createDataFrame([(s, float(v)) for s, vs in data.items() for v in vs], "slide_id bigint, value double")
    got = {r["slide_id"]: r["threshold"] for r in Ti.otsu_threshold(df).collect()}
    for s, v in data.items():
        assert np.isclose(got[s], numpy_otsu(v)), s


def geom(spark, *slides):
    return spark.createDataFrame(slides, "slide_id bigint, w0 int, h0 int, level_downsamples array<double>, props map<string,string>")


def test_resolution_sources(spark):
    downs = [1.0, 4.0]
    df = geom(
        spark, (0, 9, 9, downs, {"openslide.mpp-x": "0.5"}), (1, 9, 9, downs, {"openslide.mpp-x": "bad", "aperio.MPP": "0.3"}),
        (2, 9, 9, downs, {"openslide.mpp-x": "-1", "tiff.ResolutionUnit": "Centimeter", "tiff.XResolution": "20000"}),
        (3, 9, 9, downs, {"tiff.ResolutionUnit": "inch", "tiff.XResolution": "50800"}),
        (4, 9, 9, downs, {"tiff.ResolutionUnit": "inch", "tiff.XResolution": "0"}), (5, 9, 9, downs, {}),
    )
    got = {r["slide_id"]: r["base_mpp"] for r in T.resolve_mpp(df).collect()}
    assert got == {0: 0.5, 1: 0.3, 2: 0.5, 3: 0.5, 4: 0.25, 5: 0.25}
    with pytest.raises(Exception, match="no resolution metadata"):
        T.resolve_mpp(df, fallback=None).collect()


def test_level_and_grid(spark):
    df = T.tile_geometry(T.pick_level(T.resolve_mpp(geom(spark, (0, 1000, 500, [1.0, 2.0, 4.0], {"aperio.MPP": "0.25"}), (1, 100, 100, [1.0], {})))))
    a, b = df.orderBy("slide_id").collect()
    assert (a["level"], a["scale"], a["read_px"], a["level0_px"], a["thumb_w"], a["thumb_h"]) == (1, 1.0, 224, 448, 1000, 500)
    assert (b["read_px"], b["level0_px"]) == (448, 448)
    tiles = {(r["slide_id"], r["tile_idx"], r["x"], r["y"]) for r in T.tile_grid(df).collect()}
    assert tiles == {(0, 0, 0, 0), (0, 1, 448, 0), (1, 0, 0, 0)}


def test_build_tiles_keeps_only_tissue(spark):
    # a 40 x 40 thumbnail: purple left half, white right half with one stray purple pixel
    pixels = [
        (0, y, x, *((150, 60, 160) if x < 20 or (x, y) == (30, 30) else (250, 250, 250))) for y in range(40) for x in range(40)
    ]
    px = spark.createDataFrame(pixels, "slide_id bigint, y int, x int, r int, g int, b int")
    mask = Ti.tissue_mask(px, block=8)
    assert mask.where("tissue").agg(F.max("x"), F.count("*")).first()[:] == (19, 800)
    slide = geom(spark, (0, 4480, 4480, [1.0], {"aperio.MPP": "0.25"}))
    out = build_tiles(slide, px, thumbnail_px=40)
    assert {(r["x"] // 448, r["y"] // 448) for r in out.collect()} == {(i, j) for i in range(5) for j in range(10)}
    assert build_tiles(slide, px, thumbnail_px=40, max_patches=7).count() == 7


@pytest.mark.parametrize("thumb, step", [(30, "0.25"), (11, "0.25"), (64, "0.11"), (5, "0.9")])
def test_counting_from_pixels_equals_joining_windows(spark, thumb, step):
    rng = np.random.default_rng(4)
    sized = T.tile_geometry(
        T.pick_level(T.resolve_mpp(geom(spark, (0, 4480, 3000, [1.0], {"aperio.MPP": step}), (1, 700, 2100, [1.0], {"aperio.MPP": step})))),
        thumbnail_px=thumb,
    )
    cells = [(s, y, x, bool(rng.random() < 0.6)) for s in (0, 1) for y in range(thumb + 2) for x in range(thumb + 2)]
    mask = spark.createDataFrame(cells, "slide_id bigint, y int, x int, keep boolean")
    slow = {(r["slide_id"], r["tile_idx"]): r["fraction"] for r in T.tissue_fraction(T.tile_pixel_join(T.tile_grid(sized), mask)).collect()}
    fast = {(r["slide_id"], r["tile_idx"]): r["fraction"] for r in T.tile_tissue(sized, mask).collect()}
    assert slow == pytest.approx(fast) and len(slow) > 1
    kept = {(r["slide_id"], r["tile_idx"]): r["fraction"] for r in T.tissue_tiles(sized, mask, 0.5).collect()}
    assert kept == pytest.approx({k: v for k, v in slow.items() if v >= 0.5})


def test_grid_is_dealt_to_tasks_by_tiles(spark, monkeypatch):
    sized = T.tile_geometry(T.pick_level(T.resolve_mpp(geom(spark, (0, 9000, 7000, [1.0], {}), (1, 100, 100, [1.0], {}), (2, 500, 5000, [1.0], {}))))).coalesce(1)
    whole = sorted(T.tile_grid(sized).collect())
    monkeypatch.setattr(T, "TASK_TILES", 20)
    monkeypatch.setattr(T, "STRIPE_TILES", 50)
    dealt = T.tile_grid(sized)
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert sorted(dealt.collect()) == whole and len(sizes) > 2 and max(r["count"] for r in sizes) < len(whole) / 2


def test_windows_across_mask_blocks(spark):
    rng = np.random.default_rng(5)
    kept = rng.random((150, 130)) < 0.5
    mask = spark.createDataFrame([(7, y, x, bool(kept[y, x])) for y in range(150) for x in range(130)], "slide_id bigint, y int, x int, keep boolean")
    bits = {(r["_by"], r["_bx"]): r["_lines"] for r in T.mask_blocks(mask).collect()}
    assert all((bits[y // 64, x // 64].get(y, 0) >> x % 64) & 1 == kept[y, x] for y in range(150) for x in range(130))
    tiles = spark.createDataFrame([(7, 0, 50, 60, 90, 0.5, 65, 75), (7, 1, 0, 0, 300, 0.5, 130, 150), (8, 0, 0, 0, 2, 1.0, 9, 1)],
                                  "slide_id bigint, tile_idx bigint, x bigint, y bigint, level0_px int, thumb_ratio double, thumb_w int, thumb_h int")
    got = {tuple(r) for r in T.tile_pixel_join(tiles, mask).collect()}
    window = lambda t, ys, xs: {(7, t, y, x, bool(kept[y, x])) for y in ys for x in xs}
    assert got == window(0, range(30, 75), range(25, 65)) | window(1, range(150), range(130)) | {(8, 0, 0, 0, False), (8, 0, 0, 1, False)}
