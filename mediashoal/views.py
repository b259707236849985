"""The catalog's tables as views over plain tables, so that queries have data.

The text is SQL that Spark and DuckDB both run, which lets one definition serve the
queries and their oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NAME = "concat(CASE WHEN doc_id % 23 = 0 THEN 'FaceTile_' ELSE 'IMG_' END, CAST(doc_id AS STRING), '.', CASE doc_id % 6 WHEN 0 THEN 'jpg' WHEN 1 THEN 'HEIC' WHEN 2 THEN 'png' WHEN 3 THEN 'mp4' WHEN 4 THEN 'mov' ELSE 'jpeg' END)"
_FOLDER = "concat('/lib/', source, '/', CASE WHEN doc_id % 29 = 0 THEN 'Backup/' WHEN doc_id % 31 = 0 THEN '.hidden/' ELSE '' END, lang, '/')"

MEDIA = f"""
SELECT doc_id AS id, concat({_FOLDER}, {_NAME}) AS path, {_NAME} AS file_name,
 CASE WHEN doc_id % 6 IN (3, 4) THEN 'video' ELSE 'image' END AS media_type, n_chars AS size_bytes,
 CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 1577836800 + (doc_id * 7919 % 1000) * 86400 END AS captured_at,
 CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 1600000000 + doc_id * 3600 END AS modified_at,
 CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 1590000000 + doc_id * 60 END AS created_at,
 doc_id % 17 = 0 AS missing,
 CASE WHEN doc_id % 8 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'NIKON' ELSE 'Canon' END AS camera_make,
 CASE WHEN doc_id % 9 = 0 THEN NULL ELSE concat('Model ', CAST(doc_id % 5 AS STRING)) END AS camera_model,
 CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(doc_id * 37 % 18001 AS DOUBLE) / CAST(100 AS DOUBLE) - 90 END AS latitude,
 CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(doc_id * 101 % 36001 AS DOUBLE) / CAST(100 AS DOUBLE) - 180 END AS longitude,
 CAST(NULL AS BIGINT) AS width, CAST(NULL AS BIGINT) AS height, text AS content FROM documents"""

FACES = """
SELECT vec_id AS id, CAST((vec_id - vec_id % 2) / 2 AS BIGINT) AS media_item_id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE CAST(label AS BIGINT) END AS person_id,
 embedding AS vector FROM embeddings"""

PEOPLE = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(1600000000 AS BIGINT) AS created_at FROM nation"

VECTORS = "SELECT vec_id AS id, vec_id AS media_item_id, CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS model, embedding AS vector FROM embeddings"

PROCESSING = """
SELECT l.doc_id AS media_item_id, 'embeddings' AS processor, 'clip' AS model, CASE WHEN l.doc_id % 10 = 0 THEN d.n_chars + 1 ELSE d.n_chars END AS size_bytes,
 CASE WHEN l.doc_id % 5 = 0 THEN NULL ELSE 1600000000 + l.doc_id * 3600 END AS modified_at FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""

#: The digest function is the one word in which the engines differ.
CLEANUP = """
SELECT m.path, CASE WHEN m.id % 10 = 0 THEN m.size_bytes + 1 ELSE m.size_bytes END AS size_bytes, m.modified_at,
 CASE WHEN l.quality = 1 THEN SHA(m.content) END AS sha256, CASE WHEN l.toxic = 0 THEN CAST(640 AS BIGINT) END AS width, CASE WHEN l.toxic = 0 THEN CAST(480 AS BIGINT) END AS height,
 CASE WHEN l.toxic = 0 THEN lpad(CAST(m.size_bytes % 7 AS STRING), 4, '0') END AS ahash, CASE WHEN l.toxic = 0 THEN '0f0f' END AS dhash,
 CASE WHEN l.toxic = 0 THEN CASE WHEN m.id % 5 = 0 THEN 'ffff' ELSE lpad(CAST(m.id % 4 AS STRING), 4, '0') END END AS phash,
 CAST(1700000000 + m.id AS BIGINT) AS updated_at FROM labels l JOIN media m ON m.id = l.doc_id"""

#: Fingerprints from the signs of vectors: few ahash buckets, near hashes inside them.
PRINTS = """
SELECT concat('/p/', CAST(vec_id AS STRING)) AS path, CAST(lpad(CAST(label AS STRING), 2, '0') AS STRING) AS ahash,
 lpad(CAST(vec_id % 97 AS STRING), 4, '0') AS phash, lpad(CAST(vec_id % 31 AS STRING), 4, '0') AS dhash FROM embeddings"""

#: A listing of the same library later: some files gone, some changed, some new.
LISTING = """
SELECT path, file_name, media_type, CASE WHEN id % 11 = 0 THEN size_bytes + 5 ELSE size_bytes END AS size_bytes, modified_at, created_at, captured_at,
 CAST(1800000000 AS BIGINT) AS imported_at FROM media WHERE id % 13 <> 0
UNION ALL
SELECT concat(path, '.new.jpg'), concat(file_name, '.new.jpg'), 'image', size_bytes, modified_at, created_at, captured_at, CAST(1800000000 AS BIGINT) FROM media WHERE id % 19 = 0"""

#: What reading the folders below /lib would give: files, their folders, hollow ones, an error.
ENTRIES = """
SELECT '/lib' AS root, path, regexp_replace(path, '/[^/]*$', '') AS parent, false AS is_dir, size_bytes, created_at, modified_at, CAST(NULL AS STRING) AS error FROM media
UNION ALL SELECT DISTINCT '/lib', regexp_replace(path, '/[^/]*$', ''), regexp_replace(regexp_replace(path, '/[^/]*$', ''), '/[^/]*$', ''), true, CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS STRING) FROM media
UNION ALL SELECT DISTINCT '/lib', concat('/lib/hollow/', file_name, '/in'), concat('/lib/hollow/', file_name), true, CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS STRING) FROM media WHERE missing
UNION ALL SELECT DISTINCT '/lib', concat('/lib/hollow/', file_name), '/lib/hollow', true, CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS STRING) FROM media WHERE missing
UNION ALL SELECT '/lib', '/lib/closed', '/lib', true, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), '/lib/closed: Permission denied'"""

_TABLES = ("documents", "embeddings", "labels", "nation", "pages", "events")
_VIEWS = {"media": MEDIA, "faces": FACES, "people": PEOPLE, "vectors": VECTORS, "processing": PROCESSING, "cleanup": CLEANUP, "prints": PRINTS, "listing": LISTING, "entries": ENTRIES}


class Views:
    """Reads the tables of a directory, and makes each view from them when asked."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        sql = spark_sql(_VIEWS[name])
        return self.spark.sql(_braced(sql), **{t: self.table(t) for t in _TABLES if _used(sql, t)}, **{v: getattr(self, v) for v in ("media",) if _used(sql, v)})


def _used(sql: str, name: str) -> bool:
    return any(f" {w} {name}" in f" {sql.replace(chr(10), ' ')} " for w in ("FROM", "JOIN"))


def _braced(sql: str) -> str:
    """Table names as parameters of ``spark.sql``, which leaves no temporary views."""
    for name in (*_TABLES, "media"):
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {name}", f"{word} {{{name}}}")
    return sql


def spark_sql(sql: str) -> str:
    return sql.replace("SHA(m.content)", "sha2(m.content, 256)")


def with_views(query: str) -> str:
    """The views that a DuckDB query names, as common table expressions before it."""
    needed, text = [], query
    for name in reversed(_VIEWS):
        if _used(text, name) or f", {name} " in text:
            needed.insert(0, name)
            text += _VIEWS[name]
    ctes = ", ".join(f"{n} AS {'MATERIALIZED ' if n == 'entries' else ''}({_VIEWS[n]})" for n in sorted(needed, key=list(_VIEWS).index)).replace("SHA(m.content)", "sha256(m.content)")
    own = f", {query[5:]}" if query.startswith("WITH ") else f" {query}"
    return f"WITH RECURSIVE {ctes}{own}" if ctes else query
