"""Frame sequences: (clip, frame_idx, width, height, pixels array<int>)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import raster as R

#: Named pipelines: the transforms in order.
PRESETS = {"raw": [], "palette": ["palette"], "predictive": ["ycocg", "med", "planar"], "delta": ["delta"], "delta+predictive": ["delta", "ycocg", "med", "planar"], "best": ["ycocg", "med", "planar"]}


def with_previous(frames: DataFrame) -> DataFrame:
    """Frames with ``previous``: the pixels of the frame just before in its clip if that has the same geometry, else null.

    A self-join on the frame number, so a change of geometry is seen and no clip has to fit one task.
    """
    p = frames.select("clip", (F.col("frame_idx") + 1).alias("frame_idx"), F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("pixels").alias("_p"))
    x = frames.join(p, ["clip", "frame_idx"], "left")
    return x.withColumn("previous", F.when((F.col("_w") == F.col("width")) & (F.col("_h") == F.col("height")), F.col("_p"))).drop("_w", "_h", "_p")


def bands(frames: DataFrame, n: int) -> DataFrame:
    """Frames cut into at most n bands of whole rows, each a row with its own height and ``band``; nothing refers across a band's edge."""
    rows = F.ceil(F.col("height") / n)
    count = F.ceil(F.col("height") / rows).cast("int")
    x = frames.withColumn("_rows", rows.cast("int")).withColumn("band", F.explode(F.sequence(F.lit(0), count - 1)))
    size = F.col("_rows") * F.col("width") * 3
    x = x.withColumn("pixels", F.slice("pixels", F.col("band") * size + 1, size))
    return x.withColumn("height", F.least(F.col("_rows"), F.col("height") - F.col("band") * F.col("_rows"))).drop("_rows")


def transform(frames: DataFrame, steps: list[str], order: str = "band") -> DataFrame:
    """Applies steps in their fixed order: delta, xor, dirsim, ycocg, med or sub, planar on bands; on whole frames dirsim is left out and palette and flag end the chain.

    dirsim and flag put their codes into ``codes``, palette puts its colours into ``colours``.
    """
    x = with_previous(frames) if {"delta", "xor"} & set(steps) else frames
    if "delta" in steps:
        x = x.withColumn("pixels", F.when(F.col("previous").isNotNull(), R.delta(F.col("pixels"), F.col("previous"))).otherwise(F.col("pixels")))
    if "xor" in steps:
        x = x.withColumn("pixels", F.when(F.col("previous").isNotNull(), R.xor(F.col("pixels"), F.col("previous"))).otherwise(F.col("pixels")))
    if order == "frame" and "palette" in steps:
        return x.withColumn("colours", R.palette(F.col("pixels"))).withColumn("pixels", R.palette_index(F.col("pixels"), F.col("colours")))
    if order == "frame" and "flag" in steps or order == "band" and "dirsim" in steps:
        x = x.withColumn("codes", R.neighbour_codes(F.col("pixels"), F.col("width"), far=order == "band")).withColumn("pixels", R.zero_matched(F.col("pixels"), F.col("codes")))
        if order == "frame":
            return x
    if "ycocg" in steps:
        x = x.withColumn("pixels", R.ycocg_forward(F.col("pixels")))
    if "med" in steps or "sub" in steps:
        x = x.withColumn("pixels", R.predict(F.col("pixels"), F.col("width"), median="med" in steps))
    return x.withColumn("pixels", R.to_planar(F.col("pixels"))) if "planar" in steps else x


def undo_predict_frame(a: np.ndarray, width: int, median: bool = True, channels: int = 3) -> np.ndarray:
    """Each value needs its decoded neighbours to the left, above and between: so all pixels of an anti-diagonal are decoded at once.

    Without the median a row needs itself alone: running sums, from the column of first pixels on.
    """
    x = a.reshape(-1, width, channels).astype(np.int64)
    if not x.size:
        return a.astype(np.int64)
    if not median:
        first = np.cumsum(x[:, :1], axis=0)
        return (np.concatenate([first, first + np.cumsum(x[:, 1:], axis=1)], axis=1) % 256).ravel()
    height = len(x)
    out = np.zeros_like(x)
    out[0] = np.cumsum(x[0], axis=0) % 256
    out[:, 0] = np.cumsum(x[:, 0], axis=0) % 256
    for s in range(2, height + width - 1):
        rows = np.arange(max(1, s - width + 1), min(height - 1, s - 1) + 1)
        if not len(rows):
            continue
        cols = s - rows
        left, up, corner = out[rows, cols - 1], out[rows - 1, cols], out[rows - 1, cols - 1]
        high, low = np.maximum(left, up), np.minimum(left, up)
        pred = np.where(corner >= high, low, np.where(corner <= low, high, left + up - corner))
        out[rows, cols] = (x[rows, cols] + pred) % 256
    return out.ravel()


def undo_predict(frames: DataFrame, median: bool = True) -> DataFrame:
    """Inverse of the predictors, frame by frame in Arrow batches: inherently sequential inside a frame."""
    schema = frames.schema
    at, wide = frames.columns.index("pixels"), frames.columns.index("width")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [undo_predict_frame(np.array(p, np.int64), w, median).tolist() for p, w in zip(b.column(at).to_pylist(), b.column(wide).to_pylist(), strict=True)]
            cols = [pa.array(done, b.schema.field(i).type) if i == at else b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return frames.mapInArrow(run, schema)


def undo_neighbour_codes(a: np.ndarray, codes: np.ndarray, width: int) -> np.ndarray:
    """Inverse of dirsim and flag."""
    x = a.reshape(-1, 3).copy()
    back = {1: 1, 2: width, 3: width + 1, 4: width - 1}
    for p in np.nonzero(codes)[0]:
        x[p] = x[p - back[int(codes[p])]]
    return x.ravel()


def undo_frame(a: np.ndarray, codes: np.ndarray | None, before: np.ndarray | None, width: int, steps: list[str]) -> np.ndarray:
    """Inverse of ``transform`` on one frame or band, given the decoded one before it."""
    if "planar" in steps:
        a = a.reshape(3, -1).T.ravel()
    if "med" in steps or "sub" in steps:
        a = undo_predict_frame(a, width, "med" in steps)
    if "ycocg" in steps:
        y, co, cg = a.reshape(-1, 3).T
        t = (y - (((cg + 128) % 256 - 128) >> 1)) % 256
        b = (t - (((co + 128) % 256 - 128) >> 1)) % 256
        a = np.stack([(b + co) % 256, (cg + t) % 256, b], 1).ravel()
    if codes is not None:
        a = undo_neighbour_codes(a, codes, width)
    if before is not None and "xor" in steps:
        a = a ^ before
    if before is not None and "delta" in steps:
        a = (a + before) % 256
    return a


def undo_transform(frames: DataFrame, steps: list[str]) -> DataFrame:
    """Inverse of ``transform``: clips are dealt out, sorted in the shuffle and streamed, so only the frame before is held."""
    keep = ["clip", "frame_idx", "width", "height", "pixels"]
    has_codes = "codes" in frames.columns
    x = frames.select(*keep, *["codes"] * has_codes).repartition("clip").sortWithinPartitions("clip", "frame_idx")
    schema = frames.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None, None, None)
        for b in batches:
            done = []
            for r in b.to_pylist():
                key = (r["clip"], r["frame_idx"] - 1, (r["width"], r["height"]))
                before = last[3] if key == last[:3] else None
                a = undo_frame(np.array(r["pixels"], np.int64), np.array(r["codes"]) if has_codes else None, before, r["width"], steps)
                last = (r["clip"], r["frame_idx"], (r["width"], r["height"]), a)
                done.append(a.tolist())
            cols = [pa.array(done, b.schema.field(i).type) if n == "pixels" else b.column(i) for i, n in enumerate(keep)]
            yield pa.RecordBatch.from_arrays(cols, names=keep)

    return x.mapInArrow(run, schema)


def hits(codes: Column) -> Column:
    return F.size(F.filter(codes, lambda c: c > 0)).cast("long")


def stored_bytes(frames: DataFrame, header: int = 876, strip_geo: bool = False) -> DataFrame:
    """Bytes of each frame's file; without its geographic fields the header is 16 bytes shorter."""
    return frames.withColumn("stored_bytes", (F.lit(header - 16 * strip_geo) + F.col("width") * F.col("height") * 3).cast("long"))
