import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import raster as R
from quern.operators import raster as O

FRAME = "clip int, frame_idx int, width int, height int, pixels array<int>"


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(7)
    rows = [(c, i, w, h, rng.integers(0, 256 if c else 3, w * h * 3).tolist()) for c in range(2) for i, (w, h) in enumerate([(4, 3), (4, 3), (3, 4), (3, 4), (1, 1), (5, 1)])]
    return spark.createDataFrame(rows, FRAME).cache()


def pixels(df):
    return {(r.clip, r.frame_idx): list(r.pixels) for r in df.collect()}


@pytest.mark.parametrize("median", [True, False])
def test_predictors_round_trip(frames, median):
    x = frames.withColumn("pixels", R.predict(F.col("pixels"), F.col("width"), median=median))
    assert pixels(O.undo_predict(x, median)) == pixels(frames)


def test_colour_and_planes_round_trip(frames):
    x = frames.withColumn("pixels", R.from_planar(R.to_planar(R.ycocg_inverse(R.ycocg_forward(F.col("pixels"))))))
    assert pixels(x) == pixels(frames)


def test_delta_is_only_against_the_frame_before_with_the_same_geometry(frames):
    got, was = pixels(O.transform(frames, ["delta"])), pixels(frames)
    assert got[0, 1] == [(a - b) % 256 for a, b in zip(was[0, 1], was[0, 0], strict=True)]
    assert all(got[c, i] == was[c, i] for c in (0, 1) for i in (0, 2, 4, 5))
    x = O.transform(O.transform(frames, ["xor"]).select(*frames.columns), [])
    assert pixels(x)[1, 3] == [a ^ b for a, b in zip(was[1, 3], was[1, 2], strict=True)]


@pytest.mark.parametrize(("step", "order"), [("dirsim", "band"), ("flag", "frame")])
def test_neighbour_codes_round_trip(frames, step, order):
    was = pixels(frames)
    found = 0
    for r in O.transform(frames, [step], order).collect():
        back = O.undo_neighbour_codes(np.array(r.pixels), np.array(r.codes), r.width)
        assert back.tolist() == was[r.clip, r.frame_idx]
        found += sum(c > 0 for c in r.codes)
    assert found


def test_bands_cut_whole_rows(frames):
    for n in (1, 2, 3, 20):
        got: dict = {}
        for r in O.bands(frames, n).orderBy("band").collect():
            assert len(r.pixels) == r.width * r.height * 3
            got.setdefault((r.clip, r.frame_idx), []).extend(r.pixels)
        assert got == pixels(frames)


def test_palette_bits(spark):
    x = spark.createDataFrame([([1, 2, 3] * 4,), (list(range(15)),)], "pixels array<int>")
    assert [r[0] for r in x.select(R.pointer_bits(R.palette(F.col("pixels")))).collect()] == [1, 3]


@pytest.mark.parametrize("steps", [["delta"], ["xor"], ["delta", "ycocg", "med", "planar"], ["xor", "dirsim", "ycocg", "sub"], O.PRESETS["predictive"]])
def test_chains_round_trip(frames, steps):
    x = O.transform(frames, steps)
    assert pixels(O.undo_transform(x, steps)) == pixels(frames)
