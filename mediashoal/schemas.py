"""Explicit schemas of the catalog's tables; timestamps are epoch seconds."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _S, _D, _B = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


MEDIA = _schema(
    id=_L, path=_S, file_name=_S, extension=_S, media_type=_S, size_bytes=_L, created_at=_L, modified_at=_L, imported_at=_L, missing=_B, camera_make=_S, camera_model=_S,
    lens_model=_S, captured_at=_L, latitude=_D, longitude=_D, metadata_json=_S,
)
PEOPLE = _schema(id=_L, name=_S, created_at=_L)
FACES = _schema(id=_L, media_item_id=_L, person_id=_L, x=_D, y=_D, width=_D, height=_D, confidence=_D, created_at=_L)
EMBEDDINGS = _schema(id=_L, media_item_id=_L, face_id=_L, model=_S, vector=T.ArrayType(T.FloatType()), created_at=_L)
PROCESSING_CACHE = _schema(media_item_id=_L, processor=_S, model=_S, size_bytes=_L, modified_at=_L, processed_at=_L)
SETTINGS = _schema(key=_S, value=_S, updated_at=_L)
LIBRARY_FOLDERS = _schema(id=_L, path=_S, created_at=_L)
CLEANUP_CACHE = _schema(path=_S, size_bytes=_L, modified_at=_L, sha256=_S, width=_L, height=_L, ahash=_S, dhash=_S, phash=_S, updated_at=_L)

TABLES = {
    "media_items": MEDIA,
    "people": PEOPLE,
    "faces": FACES,
    "embeddings": EMBEDDINGS,
    "media_processing_cache": PROCESSING_CACHE,
    "settings": SETTINGS,
    "library_folders": LIBRARY_FOLDERS,
    "cleanup_file_cache": CLEANUP_CACHE,
}

#: The model of face embeddings, and the processors of the cache.
FACE_MODEL = "insightface-buffalo_l"
FACE_THRESHOLD = 0.42
