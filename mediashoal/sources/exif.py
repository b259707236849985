"""EXIF tags of JPEG and TIFF bytes, by the public TIFF 6.0 and Exif 2.3 layouts."""

from __future__ import annotations

import struct

# Tag numbers, and bytes of each TIFF field type.
MAKE, MODEL, ORIENTATION, EXIF_IFD, GPS_IFD, TAKEN, LENS = 0x010F, 0x0110, 0x0112, 0x8769, 0x8825, 0x9003, 0xA434
GPS_LAT_REF, GPS_LAT, GPS_LNG_REF, GPS_LNG = 1, 2, 3, 4
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _tiff_block(data: bytes) -> bytes | None:
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        if marker == 0xDA:
            return None
        at += 2 + size
    return None


def _fields(block: bytes, order: str, at: int) -> dict[int, object]:
    out: dict[int, object] = {}
    (n,) = struct.unpack_from(order + "H", block, at)
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", block, at + 2 + 12 * k)
        size = SIZES.get(kind, 0) * count
        where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", block, at + 10 + 12 * k)[0]
        if kind == 2:
            out[tag] = block[where : where + count].split(b"\0")[0].decode("utf-8", "replace")
        elif kind == 3:
            out[tag] = struct.unpack_from(order + "H", block, where)[0]
        elif kind == 4:
            out[tag] = struct.unpack_from(order + "I", block, where)[0]
        elif kind in (5, 10):
            pairs = struct.unpack_from(order + ("II" if kind == 5 else "ii") * count, block, where)
            out[tag] = [a / b if b else float("nan") for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
    return out


def orientation(data: bytes) -> int:
    """1 to 8; 1 (upright) where the tag is absent, odd or damaged."""
    try:
        block = _tiff_block(bytes(data))
        if block is None:
            return 1
        order = "<" if block[:2] == b"II" else ">"
        found = _fields(block, order, struct.unpack_from(order + "I", block, 4)[0]).get(ORIENTATION)
    except (struct.error, TypeError, UnicodeDecodeError):
        return 1
    return found if isinstance(found, int) and 1 <= found <= 8 else 1


def read_exif(data: bytes) -> dict[str, object]:
    """Known tags under plain names; empty if there is none or it is damaged."""
    try:
        block = _tiff_block(bytes(data))
        if block is None:
            return {}
        order = "<" if block[:2] == b"II" else ">"
        main = _fields(block, order, struct.unpack_from(order + "I", block, 4)[0])
        inner = _fields(block, order, main[EXIF_IFD]) if EXIF_IFD in main else {}
        gps = _fields(block, order, main[GPS_IFD]) if GPS_IFD in main else {}
    except (struct.error, TypeError, UnicodeDecodeError):
        return {}
    found = {
        "make": main.get(MAKE), "model": main.get(MODEL), "lens": inner.get(LENS), "taken": inner.get(TAKEN),
        "lat": gps.get(GPS_LAT), "lng": gps.get(GPS_LNG), "lat_ref": gps.get(GPS_LAT_REF), "lng_ref": gps.get(GPS_LNG_REF),
    }
    return {k: v for k, v in found.items() if isinstance(v, list if k in ("lat", "lng") else str)}
