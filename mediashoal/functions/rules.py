"""Path and media rules as columns: typing, exclusion, face tiles, prefixes, LIKE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by media type, and folder names that are left out.
IMAGE_EXTENSIONS = (
    "jpg", "jpeg", "jpe", "jfif", "png", "gif", "webp", "bmp", "dib", "tif", "tiff", "heic", "heif", "avif", "svg", "ico", "raw", "arw", "cr2", "cr3",
    "nef", "nrw", "orf", "rw2", "raf", "dng", "pef", "srw",
)
VIDEO_EXTENSIONS = ("mp4", "mov", "m4v", "avi", "mkv", "webm", "wmv", "mpg", "mpeg", "3gp", "3g2", "mts", "m2ts", "ts")
EXCLUDED_NAMES = (
    "thumbnails", "thumbnail", "thumbs", ".thumbnails", "ipod photo cache", "apple tv photo cache", "photo cache", "previews", "preview", "heic-conversions",
    "derivatives", "renders", "proxies", "database", "contents", "backup", "private", "cpl", "cloudsharing", "journals", "__macosx", ".spotlight-v100",
    ".temporaryitems", ".trashes",
)
FACE_TILE = "facetile"

#: Names that hold no other name: looking for these finds all.
SHORTEST_NAMES = tuple(n for n in EXCLUDED_NAMES if not any(o != n and o in n for o in EXCLUDED_NAMES))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Only A-Z, as the catalog's comparisons are ASCII case-insensitive."""
    return F.translate(c, UPPER, LOWER)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Lower-cased part after the last dot; none for names that only begin with one."""
    return ascii_lower(F.nullif(F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1), F.lit("")))


def media_type(ext: Column) -> Column:
    """``image``, ``video`` or null; leading dots and ASCII case don't matter."""
    plain = ascii_lower(F.ltrim(ext, F.lit(".")))
    return F.when(plain.isin(*IMAGE_EXTENSIONS), F.lit("image")).when(plain.isin(*VIDEO_EXTENSIONS), F.lit("video"))


def is_excluded(path: Column) -> Column:
    """Any component begins with a dot or equals a listed name."""
    return F.exists(F.split(path, "/"), lambda part: part.startswith(".") | ascii_lower(part).isin(*EXCLUDED_NAMES))


def is_face_tile(name: Column, kind: Column) -> Column:
    return F.coalesce((kind == "image") & ascii_lower(name).startswith(FACE_TILE), F.lit(False))


def clean_path(path: Column) -> Column:
    """Without the prefix of extended-length paths."""
    return F.regexp_replace(path, r"^\\\\\?\\", "")


def like(value: Column, pattern: str) -> Column:
    """``%pattern%`` with live ``%`` and ``_`` and ASCII case-insensitivity."""
    text = "".join(chr(ord(c) + 32) if c in UPPER else c for c in pattern).replace("~", "~~")
    return F.like(ascii_lower(value), F.lit(f"%{text}%"), F.lit("~"))


def is_listed(path: Column, name: Column, kind: Column) -> Column:
    """The always-on rule of queries: substrings of the path, unlike ``is_excluded``."""
    lowered = ascii_lower(path)
    ok = ~name.startswith(".") & ((kind != "image") | ~ascii_lower(name).startswith(FACE_TILE))
    for listed in SHORTEST_NAMES:
        hit = F.like(lowered, F.lit(f"%{listed}%")) if "_" in listed else lowered.contains(listed)
        ok = ok & ~hit
    return ok


def under_root(path: Column, root: str) -> Column:
    """Component-wise: ``/a/b`` is not under ``/a/bc``."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(f"{root}/")
