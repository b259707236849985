"""Perceptual hashes of grey images, and plug-in models run over Arrow batches.

No image library is needed: binary PGM and PNG are read here, other formats by an image
library if there is one or by a ``decode`` function that is handed in. Failures are an
``error`` column, file by file.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashoal.sources.exif import orientation
from mediashoal.storage import materialize, small_batches

def hex_bits(bits: np.ndarray) -> str:
    """Most significant bit first, in whole hex digits."""
    flat = np.asarray(bits, bool).reshape(-1)
    text = "".join("1" if b else "0" for b in flat)
    return f"{int(text, 2):0{-(-len(flat) // 4)}x}"


@lru_cache(maxsize=256)
def lanczos_weights(n: int, m: int) -> np.ndarray:
    """Rows of weights that resample n cells to m with a Lanczos window of three lobes,
    widened by the scale when shrinking, cut at the edges and summing to one."""
    scale = n / m
    wide = max(scale, 1.0)
    centres = (np.arange(m) + 0.5) * scale
    low = np.maximum(np.floor(centres - 3 * wide + 0.5), 0)
    high = np.minimum(np.floor(centres + 3 * wide + 0.5), n)
    cells = np.arange(n)
    x = (cells[None, :] + 0.5 - centres[:, None]) / wide
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    w[(cells[None, :] < low[:, None]) | (cells[None, :] >= high[:, None])] = 0
    return w / w.sum(1, keepdims=True)


def resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """By a Lanczos window, rows first, each direction rounded to bytes."""
    out = grey.astype(np.float64)
    if out.shape[1] != width:
        out = np.clip(np.floor(out @ lanczos_weights(out.shape[1], width).T + 0.5), 0, 255)
    if out.shape[0] != height:
        out = np.clip(np.floor(lanczos_weights(out.shape[0], height) @ out + 0.5), 0, 255)
    return out


def bounded_width(grey: np.ndarray, most: int | None) -> np.ndarray:
    """No wider than ``most``, in proportion; what is narrower stays as it is. No bound,
    or none over zero, changes nothing."""
    if not most or most <= 0 or grey.shape[1] <= most:
        return grey
    return resize(grey, max(1, round(grey.shape[0] * most / grey.shape[1])), most).astype(np.uint8)


@lru_cache
def _dct(n: int) -> np.ndarray:
    k, i = np.mgrid[:n, :n]
    basis = np.cos((2 * i + 1) * k * np.pi / (2 * n)) * np.sqrt(2 / n)
    basis[0] = np.sqrt(1 / n)
    return basis


def average_hash(grey: np.ndarray) -> str:
    small = resize(grey, 8, 8)
    return hex_bits(small >= small.mean())


def difference_hash(grey: np.ndarray) -> str:
    small = resize(grey, 8, 9)
    return hex_bits(small[:, 1:] > small[:, :-1])


def frequency_hash(grey: np.ndarray) -> str:
    """Low 8 x 8 of the 32 x 32 cosine transform against the median without its first."""
    basis = _dct(32)
    low = (basis @ resize(grey, 32, 32) @ basis.T)[:8, :8]
    return hex_bits(low >= np.median(low.reshape(-1)[1:]))


def write_pgm(grey: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (grey.shape[1], grey.shape[0]) + grey.astype(np.uint8).tobytes()


#: Weights of red, green and blue in grey, in parts of 2 ** 16.
RED, GREEN, BLUE = 19595, 38470, 7471


def grey_of(rgb: np.ndarray) -> np.ndarray:
    """Grey of red, green and blue bytes."""
    r, g, b = (rgb[..., k].astype(np.int64) for k in range(3))
    return ((r * RED + g * GREEN + b * BLUE + (1 << 15)) >> 16).astype(np.uint8)


def read_png(data: bytes) -> np.ndarray:
    """Grey of a PNG of 8 bits a channel without interlacing: grey or colours, with or
    without alpha (which is not used), or a palette."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        raise ValueError("a PNG of a kind that is not read")
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * channels)
    rows, above = np.zeros((height, width * channels), np.uint8), np.zeros(width * channels, np.int64)
    for y in range(height):
        rows[y] = above = _unfiltered(int(raw[y, 0]), raw[y, 1:].astype(np.int64), above, channels)
    pixels = rows.reshape(height, width, channels)
    if palette is not None and head[3] == 3:
        return grey_of(palette[pixels[..., 0]])
    return grey_of(pixels) if channels >= 3 else pixels[..., 0]


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line of a PNG from its filtered bytes and the line above (PNG specification, 9.2)."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0).reshape(-1) & 255
    if kind == 2:
        return (line + above) & 255
    out = np.zeros(len(line) + step, np.int64)
    for k, x in enumerate(line.tolist()):
        left, up = int(out[k]), int(above[k])
        if kind == 3:
            guess = (left + up) // 2
        else:
            corner = int(above[k - step]) if k >= step else 0
            guess = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))[2]
        out[k + step] = (x + guess) & 255
    return out[step:]


def read_image(data: bytes) -> np.ndarray:
    """Grey of binary PGM or PNG; of other formats if an image library is installed."""
    if data[:2] == b"P5":
        return read_pgm(data)
    if data[:4] == b"\x89PNG":
        return read_png(data)
    try:
        from PIL import Image
    except ImportError:
        raise ValueError("no known image") from None
    with Image.open(io.BytesIO(data)) as image:
        return np.asarray(image.convert("L"))


def read_pgm(data: bytes) -> np.ndarray:
    parts, at = [], 0
    while len(parts) < 4:
        while data[at : at + 1].isspace():
            at += 1
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        parts.append(data[at:end])
        at = end
    if parts[0] != b"P5":
        raise ValueError("no known image")
    width, height = int(parts[1]), int(parts[2])
    return np.frombuffer(data[at + 1 : at + 1 + width * height], np.uint8).reshape(height, width)


def turned(grey: np.ndarray, orientation: int) -> np.ndarray:
    """As an EXIF orientation of 1 to 8 says."""
    if orientation >= 5:
        grey = grey.T
    if orientation in (2, 3, 6, 7):
        grey = grey[:, ::-1]
    if orientation in (3, 4, 7, 8):
        grey = grey[::-1]
    return grey


FINGERPRINT = "path string, width bigint, height bigint, ahash string, dhash string, phash string, error string"


def fingerprints(files: DataFrame, decode: Callable[[bytes], np.ndarray] = read_image) -> DataFrame:
    """Of ``(path, content)`` rows; ``decode`` gives the grey image as it is stored, which
    is turned upright by the file's EXIF orientation. Sizes are of the upright image.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    grey = turned(decode(bytes(content)), orientation(bytes(content)))
                    rows.append((path, grey.shape[1], grey.shape[0], average_hash(grey), difference_hash(grey), frequency_hash(grey), None))
                except Exception as e:  # noqa: BLE001  any decoder's error belongs to its file
                    rows.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], [x.split()[0] for x in FINGERPRINT.split(", ")])

    small_batches(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, FINGERPRINT)


class Unsupported(ValueError):
    """An item that a model can't take."""


class Embedder(Protocol):
    """A provider of vectors; made once in each Python worker."""

    name: str
    model: str

    def embed_text(self, text: str) -> list[float]: ...

    def embed_batch(self, items: list[bytes]) -> list[list[float]]: ...


class HashEmbedder:
    """A deterministic stand-in: bytes in, unit vector out; refuses empty items."""

    name, model = "local", "hash"

    def __init__(self, dim: int = 16):
        self.dim = dim

    def _one(self, data: bytes) -> list[float]:
        if not data:
            raise Unsupported("nothing to embed")
        counts = np.bincount(np.frombuffer(data, np.uint8) % self.dim, minlength=self.dim).astype(np.float64)
        return (counts / np.sqrt((counts**2).sum())).tolist()

    def embed_text(self, text: str) -> list[float]:
        return self._one(text.encode())

    def embed_batch(self, items: list[bytes]) -> list[list[float]]:
        return [self._one(x) for x in items]


#: Models by provider, and what kinds of input each takes.
MODELS = {"local": {"hash": ("image", "video", "text")}}
PROVIDERS: dict[str, Callable[[], Embedder]] = {"local": HashEmbedder}


def register_provider(name: str, make: Callable[[], Embedder], models: dict[str, tuple[str, ...]]) -> None:
    """Adds a provider with its models and the kinds (``text``, or the first part of a
    MIME type, or a whole one) that each takes."""
    PROVIDERS[name], MODELS[name] = make, dict(models)


def list_models(provider: str | None = None) -> list[tuple[str, str]]:
    return [(p, m) for p, models in MODELS.items() if provider is None or p == provider.strip().lower() for m in models]


def refusal(provider: str, model: str, mime: str | None) -> str | None:
    """Why a model can't take a file of this MIME type, or None if it can."""
    kinds = MODELS.get(provider, {}).get(model)
    if kinds is None:
        return f"unsupported: {provider} has no model {model}"
    if set(kinds) == {"text"}:
        return f"unsupported: {model} of {provider} takes text only"
    if mime is None or not {mime, mime.split("/")[0]} & set(kinds):
        return f"unsupported: {mime or 'unknown'} for {model} of {provider}"
    return None


def provider(name: str) -> Callable[[], Embedder]:
    """By name in any case."""
    try:
        return PROVIDERS[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown provider {name}") from None


def canonical_model(model: str) -> str:
    """One name for the vision and text halves of a model."""
    return model.removesuffix("-vision").removesuffix("-text")


def bisected(items: list[bytes], embed: Callable[[list[bytes]], list[list[float]]]) -> list[tuple[list[float] | None, str | None]]:
    """(vector, None) or (None, error): a failing batch is halved until its bad items
    stand alone."""
    if not items:
        return []
    try:
        return [(v, None) for v in embed(items)]
    except Exception as e:  # noqa: BLE001  any provider's error
        if len(items) == 1:
            return [(None, f"unsupported: {e}")]
    half = len(items) // 2
    return bisected(items[:half], embed) + bisected(items[half:], embed)


def embed_files(files: DataFrame, make: Callable[[], Embedder], batch: int = 256, failures: bool = False) -> DataFrame:
    """``(id, model, vector, error)`` of ``(id, content)`` rows, ``batch`` at a time. With
    ``failures``, a provider that can't be made or breaks down fails the rows of its batch,
    in a column ``failed``, and not the job.

    With a column ``mime``, files that the provider's model does not take have an error
    and do not reach it; text has the MIME type ``text/plain``.
    """
    typed = "mime" in files.columns

    names = ["id", "model", "vector", "error", *(["failed"] if failures else [])]

    def embedded(model: Embedder, rows: pa.RecordBatch) -> list[tuple]:
        content = [bytes(c or b"") for c in rows.column(1).to_pylist()]
        why = [refusal(model.name, model.model, m) if typed else None for m in rows.column(2).to_pylist()]
        taken, found = [k for k, w in enumerate(why) if w is None], [(None, w) for w in why]
        for first in range(0, len(taken), batch):
            some = taken[first : first + batch]
            for k, one in zip(some, bisected([content[k] for k in some], model.embed_batch), strict=True):
                found[k] = one
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for rows in batches:
            failed = name = None
            try:
                model = model or make()
                name, found = canonical_model(model.model), embedded(model, rows)
            except Exception as e:  # noqa: BLE001  whatever broke belongs to these rows
                if not failures:
                    raise
                failed, found = f"{type(e).__name__}: {e}", [(None, None)] * rows.num_rows
            columns = [rows.column(0), pa.array([name] * len(found), pa.string()), pa.array([v for v, _ in found], pa.list_(pa.float32())), pa.array([e for _, e in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array([failed] * len(found), pa.string())] if failures else [])], names)

    small_batches(files.sparkSession)
    mime = F.col("mime") if typed else F.lit(None).cast("string")
    schema = "id bigint, model string, vector array<float>, error string" + (", failed string" if failures else "")
    return files.select(F.col("id").cast("bigint").alias("id"), "content", mime.alias("mime")).mapInArrow(run, schema)


def embedding_counters(made: DataFrame) -> DataFrame:
    return made.agg(F.count("vector").alias("embedded"), (F.count("*") - F.count("vector")).alias("skipped"))


class FaceModel(Protocol):
    """Finds faces: (x, y, width, height, confidence, vector) each. A model with a method
    ``without_device`` is asked for one that runs without it when it fails."""

    def faces(self, content: bytes) -> list[tuple[float, float, float, float, float, list[float]]]: ...


def detect_faces(files: DataFrame, make: Callable[[], FaceModel]) -> tuple[DataFrame, DataFrame]:
    """Faces of ``(id, content)`` rows, boxes at least one pixel wide and high, and the
    ids with errors. A file's error does not stop others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for rows in batches:
            out = []
            for k, content in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                try:
                    try:
                        found = model.faces(bytes(content or b""))
                    except Exception:  # noqa: BLE001  a device that gave up: once more on the plain one
                        if not hasattr(model, "without_device"):
                            raise
                        model = model.without_device()
                        found = model.faces(bytes(content or b""))
                    out += [(k, x, y, max(w, 1.0), max(h, 1.0), c, v, None) for x, y, w, h, c, v in found]
                except Exception as e:  # noqa: BLE001  any model's error belongs to its file
                    out.append((k, None, None, None, None, None, None, str(e)))
            kinds = [pa.int64(), *[pa.float64()] * 5, pa.list_(pa.float32()), pa.string()]
            names = ["media_item_id", "x", "y", "width", "height", "confidence", "vector", "error"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 8, kinds, strict=True)], names)

    small_batches(files.sparkSession)
    made = files.select(F.col("id").cast("bigint").alias("id"), "content").mapInArrow(run, "media_item_id bigint, x double, y double, width double, height double, confidence double, vector array<float>, error string")
    made = materialize(made, "faces")  # both results come from one run of the model
    return made.where("error is null").drop("error"), made.where("error is not null").select("media_item_id", "error")


FACE_SETUP_MOST = 25


def face_setup_ids(ids: list[int]) -> list[int]:
    """At most FACE_SETUP_MOST ids a call."""
    if len(ids) > FACE_SETUP_MOST:
        raise ValueError(f"at most {FACE_SETUP_MOST} media a call")
    return ids
