"""Picture kernels for Arrow batches: bytes or numbers in, gray tiles of one size out.

The array functions of ``functions.arrays`` define the same steps column by column and never leave
the JVM, but per-pixel lambdas are interpreted. From a few thousand pixels per picture on, one pass
over the Arrow batch is an order of magnitude cheaper.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from maskloom.functions.arrays import GRAY_WEIGHTS, PIXEL_MAX
from maskloom.functions.resize import BATCH_PIXELS, resize_array


def gray_array(pixels: np.ndarray, bgr: bool = False) -> np.ndarray:
    """Gray picture of an (h, w, channels) array: as is for one channel, else luminance in 0..1."""
    channels = pixels.shape[2]
    if channels == 1:
        return pixels[:, :, 0]
    if channels not in (3, 4):
        raise ValueError(f"cannot turn {channels} channels into gray")
    weights = np.array(GRAY_WEIGHTS[::-1] if bgr else GRAY_WEIGHTS)
    color = pixels[:, :, :3] / PIXEL_MAX
    if channels == 4:
        alpha = pixels[:, :, 3:] / PIXEL_MAX
        color = (1 - alpha) + alpha * color
    return color @ weights


def tile_arrays(picture: np.ndarray, tile: int) -> Iterator[tuple[int, np.ndarray]]:
    """Left and right tile of the top rows, empty ones skipped."""
    top = picture[:tile]
    for number, side in enumerate((top[:, :tile], top[:, tile:])):
        if side.size:
            yield number, side


class TileKernel:
    """mapInArrow function turning pictures into tiles.

    Input columns: keep..., h, w, channels, image (binary in blue-green-red order as Spark's image
    source gives it, or numbers in red-green-blue order). Output: keep..., tile_no, h, w, image.
    """

    def __init__(
        self, keep: list[str], tile: int, target: int, normalize=False, double_scale=False, mask=False
    ):
        self.keep, self.tile, self.target = keep, tile, target
        self.normalize, self.double_scale, self.mask = normalize, double_scale, mask

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_per_batch = max(1, BATCH_PIXELS // self.target**2)
        for batch in batches:
            source, numbers, tiles = [], [], []
            for row, picture, scaled in self._pictures(batch):
                for number, side in tile_arrays(picture, self.tile):
                    source.append(row)
                    numbers.append(number)
                    tiles.append(self._finish(side, scaled))
                    if len(tiles) == rows_per_batch:
                        yield self._emit(batch, source, numbers, tiles)
                        source, numbers, tiles = [], [], []
            if tiles:
                yield self._emit(batch, source, numbers, tiles)

    def _pictures(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(row, gray picture, is it in 0..1 already?)."""
        images = batch.column("image")
        as_bytes = pa.types.is_binary(images.type) or pa.types.is_large_binary(images.type)
        shapes = zip(*(batch.column(name).to_pylist() for name in ("h", "w", "channels")))
        for row, (h, w, channels) in enumerate(shapes):
            if as_bytes:
                flat = np.frombuffer(images[row].as_buffer(), np.uint8)
            else:
                flat = images[row].values.to_numpy(zero_copy_only=False)
            yield row, gray_array(flat.reshape(h, w, channels), bgr=as_bytes), channels > 1

    def _finish(self, side: np.ndarray, scaled: bool) -> np.ndarray:
        done = resize_array(side.astype(np.float64), self.target, self.target)
        if self.mask:
            done = done != 0
        elif self.normalize and (self.double_scale or not scaled):
            done = done / PIXEL_MAX
        return done.astype(np.float32).ravel()

    def _emit(self, batch: pa.RecordBatch, source, numbers, tiles) -> pa.RecordBatch:
        pixels = self.target**2
        offsets = np.arange(len(tiles) + 1, dtype=np.int32) * pixels
        columns = {name: batch.column(name).take(pa.array(source)) for name in self.keep}
        columns["tile_no"] = pa.array(numbers, pa.int32())
        columns["h"] = columns["w"] = pa.array([self.target] * len(tiles), pa.int32())
        columns["image"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tiles)))
        names = [*self.keep, "tile_no", "h", "w", "image"]
        return pa.RecordBatch.from_arrays([columns[name] for name in names], names)
