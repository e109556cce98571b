"""Writing small PNG files with the standard library."""

import struct
import zlib

import numpy as np

_COLOR_TYPE = {1: 0, 3: 2, 4: 6}


def write_png(path, pixels: np.ndarray, bits: int = 8) -> None:
    pixels = np.asarray(pixels, np.uint8 if bits == 8 else ">u2")
    h, w = pixels.shape[:2]
    channels = 1 if pixels.ndim == 2 else pixels.shape[2]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + pixels[r].tobytes() for r in range(h))
    header = struct.pack(">IIBBBBB", w, h, bits, _COLOR_TYPE[channels], 0, 0, 0)
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    with open(path, "wb") as f:
        f.write(data)
