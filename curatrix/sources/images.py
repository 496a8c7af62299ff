"""Image bytes: a PNG decoder, EXIF days, and the perceptual hash of pixels.

Other formats need a decoder of the caller's, from bytes to RGB pixels;
``read_image``, ``hashed`` and the run over a folder take one.
"""

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Fixed values of the formats: signatures, chunk and tag numbers.
PNG = b"\x89PNG\r\n\x1a\n"
TAG_EXIF, TAG_TAKEN, TAG_ORIENTATION = 34665, 36867, 274
CHANNELS, DEPTHS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}, (1, 2, 4, 8, 16)
# The interlaced passes' first line and column, and steps down and right.
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))
#: The hash's square of pixels and of coefficients.
SIDE, LOW = 32, 8


def decode_png(data: bytes) -> np.ndarray:
    """RGB pixels of a PNG of any depth, colour kind and interlacing; alpha is left out."""
    if not data.startswith(PNG):
        raise ValueError("not a PNG")
    at, header, packed, palette = 8, None, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if header is None or header[2] not in DEPTHS or header[3] not in CHANNELS or header[3] == 3 and palette is None:
        raise ValueError("a PNG of another kind")
    width, height, depth, colour, interlaced = *header[:4], header[6]
    stream, channels = zlib.decompress(b"".join(packed)), CHANNELS[colour]
    out = np.zeros((height, width, channels), dtype=np.uint8)
    at = 0
    for top, left, down, right in PASSES if interlaced else ((0, 0, 1, 1),):
        h, w = -(-(height - top) // down), -(-(width - left) // right)
        if h <= 0 or w <= 0:
            continue
        stride = -(-w * channels * depth // 8)
        lines = np.frombuffer(stream, dtype=np.uint8, count=h * (1 + stride), offset=at).reshape(h, 1 + stride)
        at += lines.size
        values = _unfiltered(lines[:, 0], lines[:, 1:], max(1, channels * depth // 8))
        out[top::down, left::right] = _samples(values, w, channels, depth, colour == 3)
    if colour == 3:
        return palette[np.minimum(out[:, :, 0], len(palette) - 1)]
    return np.repeat(out[:, :, :1], 3, axis=2) if channels < 3 else out[:, :, :3]


def _samples(values: np.ndarray, width: int, channels: int, depth: int, whole: bool) -> np.ndarray:
    """The bytes of lines as samples of 8 bits; ``whole`` leaves palette numbers as they are."""
    if depth == 16:
        return values.reshape(len(values), width, channels, 2)[:, :, :, 0]
    if depth < 8:
        bits = np.unpackbits(values, axis=1).reshape(len(values), -1, depth)
        values = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)[:, : width * channels]
        values = values if whole else values * (255 // ((1 << depth) - 1))
    return values.reshape(len(values), width, channels)


def _unfiltered(kinds: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    """Undo the lines' filters, one diagonal of the picture at a time.

    A sample needs those to its left, above and in the corner between, which lie
    on the two diagonals before, so all samples of a diagonal are done at once,
    whatever their lines' filters.
    """
    height, width = len(lines), -(-lines.shape[1] // step)
    padded = np.zeros((height, width * step), dtype=np.uint8)
    padded[:, : lines.shape[1]] = lines
    padded = padded.reshape(height, width, step)
    if not kinds.any():
        return padded.reshape(height, -1)[:, : lines.shape[1]]
    sheet = np.zeros((width + height + 1, height + 1, step), dtype=np.uint8)  # by diagonal and line, with a margin
    for d in range(width + height - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        left, up, corner = (sheet[d + 1, y + 1].astype(np.int16), sheet[d + 1, y].astype(np.int16), sheet[d, y].astype(np.int16))
        guess = left + up - corner
        far = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
        paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
        kind = kinds[y][:, None]
        added = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, paeth], 0)
        sheet[d + 2, y + 1] = (padded[y, d - y] + added) & 255
    y, x = np.mgrid[0:height, 0:width]
    return sheet[x + y + 2, y + 1].reshape(height, -1)[:, : lines.shape[1]]


def encode_png(pixels: np.ndarray) -> bytes:
    """RGB pixels as a PNG, each line as the difference from the one above."""
    above = np.concatenate([np.zeros_like(pixels[:1]), pixels[:-1]])
    lines = (pixels - above).reshape(len(pixels), -1)
    body = zlib.compress(np.concatenate([np.full((len(lines), 1), 2, dtype=np.uint8), lines], axis=1).tobytes())
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    header = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2, 0, 0, 0)
    return PNG + chunk(b"IHDR", header) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def _tags(tiff: bytes) -> dict[int, bytes | int | str]:
    """The tags of a TIFF block's first directory and of its EXIF directory."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None:
        return {}
    found: dict = {}

    def directory(at: int) -> dict:
        out = {}
        (n,) = struct.unpack_from(order + "H", tiff, at)
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * i)
            place = at + 10 + 12 * i
            if kind == 2:
                if count > 4:
                    (place,) = struct.unpack_from(order + "I", tiff, place)
                out[tag] = tiff[place : place + count].split(b"\0")[0].decode("ascii", "replace")
            elif kind in (3, 4):
                (out[tag],) = struct.unpack_from(order + ("H" if kind == 3 else "I"), tiff, place)
        return out

    try:
        (first,) = struct.unpack_from(order + "I", tiff, 4)
        found = directory(first)
        if isinstance(found.get(TAG_EXIF), int):
            found |= {("exif", k): v for k, v in directory(found[TAG_EXIF]).items()}
    except struct.error:
        pass
    return found


def exif(data: bytes) -> dict:
    """EXIF tags of JPEG, PNG or TIFF bytes; those of the EXIF directory under ("exif", tag)."""
    if data[:2] in (b"II", b"MM"):
        return _tags(data)
    if data.startswith(PNG):
        at = 8
        while at + 8 <= len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            if kind == b"eXIf":
                return _tags(data[at + 8 : at + 8 + size])
            at += 12 + size
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            (size,) = struct.unpack(">H", data[at + 2 : at + 4])
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return _tags(data[at + 10 : at + 2 + size])
            at += 2 + size
    return {}


def taken(data: bytes) -> str | None:
    """The time of capture as EXIF writes it, from its own directory first."""
    tags = exif(data)
    value = tags.get(("exif", TAG_TAKEN)) or tags.get(TAG_TAKEN)
    return value if isinstance(value, str) and value else None


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels turned and mirrored as an EXIF orientation of 1 to 8 says."""
    if orientation in (5, 6, 7, 8):
        pixels = pixels.transpose(1, 0, 2)
    flip_x = orientation in (2, 3, 6, 7)
    flip_y = orientation in (3, 4, 7, 8)
    return pixels[:: -1 if flip_y else 1, :: -1 if flip_x else 1]


def read_image(data: bytes, decode: Callable[[bytes], np.ndarray] = decode_png) -> np.ndarray:
    orientation = exif(data).get(TAG_ORIENTATION, 1)
    return upright(decode(data), orientation if isinstance(orientation, int) else 1)


def _windowed(n: int, size: int = SIDE) -> np.ndarray:
    """The Lanczos resampling matrix from n pixels to ``size``."""
    scale = max(n / size, 1.0)
    centers = (np.arange(size) + 0.5) * n / size
    x = (np.arange(n)[None, :] + 0.5 - centers[:, None]) / scale
    weights = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def fitted(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """The picture at the greatest size inside width and height that keeps its shape; never enlarged."""
    h, w = pixels.shape[:2]
    scale = min(width / w, height / h, 1.0)
    if scale == 1.0:
        return pixels
    rows, columns = _windowed(h, max(1, round(h * scale))), _windowed(w, max(1, round(w * scale)))
    return np.clip(np.rint(np.einsum("yh,hwc,xw->yxc", rows, pixels, columns, optimize=True)), 0, 255).astype(np.uint8)


def cropped(pixels: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The whole pixels of a box (x, y, width, height) that lie in the picture."""
    x, y, w, h = box
    return pixels[max(0, int(y)) : max(0, int(y + h)), max(0, int(x)) : max(0, int(x + w))]


def outlined(pixels: np.ndarray, box: tuple[float, float, float, float], colour: tuple[int, int, int], line: int = 2) -> np.ndarray:
    """A copy with the box's edges drawn inwards."""
    x, y, w, h = box
    top, left = max(0, round(y)), max(0, round(x))
    bottom, right = min(len(pixels) - 1, round(y + h)), min(pixels.shape[1] - 1, round(x + w))
    out = pixels.copy()
    if top <= bottom and left <= right:
        frame = out[top : bottom + 1, left : right + 1]
        inside = frame[line:-line, line:-line].copy()
        frame[:] = colour
        frame[line:-line, line:-line] = inside
    return out


#: The square in which a face's sharpness is measured, and the
#: shares of red, green and blue in a gray of 14 bits.
FACE_SIDE, GRAY = 112, (4899, 9617, 1868)


def face_quality(pixels: np.ndarray, box: tuple[float, float, float, float]) -> tuple[float, float]:
    """(blur, brightness) of a face: the variance of its Laplacian, and its mean gray, in a fixed square."""
    crop = cropped(pixels, box)
    if not crop.size:
        raise ValueError("a face without pixels")
    gray = (_bilinear(crop, FACE_SIDE).astype(np.int64) @ np.array(GRAY) + (1 << 13)) >> 14
    edge = np.pad(gray, 1, mode="reflect").astype(float)
    around = edge[:-2, 1:-1] + edge[2:, 1:-1] + edge[1:-1, :-2] + edge[1:-1, 2:]
    return float((around - 4 * gray).var()), float(gray.mean())


def _bilinear(pixels: np.ndarray, side: int) -> np.ndarray:
    """A square of the picture, each point between its four nearest pixels."""

    def weights(n: int) -> np.ndarray:
        at = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(n - 2, 0))
        out = np.zeros((side, n))
        out[np.arange(side), low] = 1 - (at - low)
        out[np.arange(side), np.minimum(low + 1, n - 1)] += at - low
        return out

    return np.rint(np.einsum("yh,hwc,xw->yxc", weights(pixels.shape[0]), pixels, weights(pixels.shape[1]), optimize=True)).astype(np.uint8)


def phash(pixels: np.ndarray) -> int:
    """64 bits: which low frequencies exceed the median of all but the first."""
    gray = np.round(pixels @ np.array([299, 587, 114]) / 1000)
    small = np.clip(np.round(_windowed(gray.shape[0]) @ gray @ _windowed(gray.shape[1]).T), 0, 255)
    basis = np.cos(np.pi * np.outer(np.arange(LOW), 2 * np.arange(SIDE) + 1) / (2 * SIDE))
    norm = np.full(LOW, np.sqrt(2 / SIDE))
    norm[0] = np.sqrt(1 / SIDE)
    low = ((norm[:, None] * basis) @ small @ (norm[:, None] * basis).T).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return sum(1 << int(i) for i in np.flatnonzero(bits))


def hashed(files: DataFrame, decode: Callable[[bytes], np.ndarray] = decode_png) -> DataFrame:
    """(path, sha256, phash, width, height, taken, error) of (path, content) rows.

    ``phash`` is the unsigned hash in a signed bigint; a file that cannot be
    decoded gives an error in place of the values.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    pixels = read_image(bytes(content), decode)
                    value = phash(pixels)
                    out.append((path, hashlib.sha256(content).hexdigest(), value - (1 << 64) if value >> 63 else value, pixels.shape[1], pixels.shape[0], taken(bytes(content)), None))
                except (ValueError, zlib.error, struct.error) as error:
                    out.append((path, None, None, None, None, None, str(error) or "unreadable"))
            yield pd.DataFrame(out, columns=["path", "sha256", "phash", "width", "height", "taken", "error"]).astype({"phash": "Int64", "width": "Int64", "height": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, sha256 string, phash bigint, width bigint, height bigint, taken string, error string")
