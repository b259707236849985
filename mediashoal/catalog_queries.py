"""Queries over the catalog's commands, sources and kernels, each with its SQL.

Commands run on a catalog of their own in the shared folder, filled from the views.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mediashoal.functions import geo, rules, vectors
from mediashoal.operators import incremental, vector_search
from mediashoal.plans import cleanup, filters
from mediashoal.plans.catalog import Catalog
from mediashoal.plans.filters import SearchFilter
from mediashoal.queries import _COLUMNS, _DATE, _DESC, _DIFF, _FILES, _KEEP, _LISTED, _Q, _ids, _seed, query
from mediashoal.schemas import TABLES
from mediashoal.sources import files, folders, kernels, tree
from mediashoal.storage import fresh_path
from mediashoal.streaming import ingest
from mediashoal.views import Views

_NOW = 1_800_000_000


def _as(df: DataFrame, schema: StructType, **values) -> DataFrame:
    """``df`` in a table's schema, with constants for some columns and nulls for what it lacks."""
    known = {c: F.col(c) for c in df.columns} | {k: F.lit(x) for k, x in values.items()}
    return df.select([known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def _catalog(v: Views, **tables: DataFrame) -> Catalog:
    made = Catalog(v.spark, fresh_path(v.spark, "catalog"))
    made.commit_all({name: _as(df, TABLES[name]) for name, df in tables.items()})
    return made


def _face_vectors(v: Views) -> DataFrame:
    return v.faces.select("id", F.col("id").alias("face_id"), F.lit("f").alias("model"), "vector", F.lit(0).alias("created_at"))


# --- people and faces

_NAMED = f"SELECT f.id, CASE WHEN f.id = 7 OR (f.person_id IS NULL AND f.media_item_id <> 3 AND list_cosine_similarity(f.vector::DOUBLE[], q) >= 0.2) THEN 25 ELSE f.person_id END AS person_id FROM faces f, {_Q}"


@query("name_face", _NAMED)
def _(v):
    catalog = _catalog(v, faces=v.faces.drop("vector"), people=v.people, embeddings=_face_vectors(v))
    catalog.name_face(7, " Zoe ", 0.2)
    return catalog.read("faces").select("id", "person_id")


@query("person_get_or_create", "SELECT id, name FROM people UNION ALL SELECT 25, 'Unnamed' UNION ALL SELECT 26, 'nation_7'")
def _(v):
    catalog = _catalog(v, people=v.people)
    for name in (" NATION_7 ", "  ", "Unnamed", "nation_7"):
        catalog.person(name, _NOW)
    return catalog.read("people").select("id", "name")


@query("rename_person", "SELECT id, CASE id WHEN 3 THEN ' A name ' ELSE name END AS name FROM people")
def _(v):
    catalog = _catalog(v, people=v.people)
    catalog.rename_person(3, " A name ")
    catalog.rename_person(99, "none")
    return catalog.list_people().select("id", "name")


@query("delete_person", "SELECT f.id, nullif(f.person_id, 4) AS person_id, p.name FROM faces f LEFT JOIN people p ON p.id = nullif(f.person_id, 4)")
def _(v):
    catalog = _catalog(v, people=v.people, faces=v.faces.drop("vector"))
    catalog.delete_person(4)
    people = catalog.read("people").select(F.col("id").alias("person_id"), "name")
    return catalog.read("faces").select("id", "person_id").join(people, "person_id", "left").select("id", "person_id", "name")


_BATCH = "SELECT id FROM media WHERE camera_make = 'NIKON'"


@query(
    "replace_faces",
    f"""SELECT id, media_item_id, person_id FROM faces WHERE media_item_id NOT IN ({_BATCH}) UNION ALL
    SELECT n.id, n.media_item_id, b.person_id FROM (SELECT (SELECT max(id) FROM faces WHERE media_item_id IS NOT NULL) + row_number() OVER (ORDER BY vec_id) AS id, vec_id AS media_item_id, embedding AS vector FROM embeddings WHERE vec_id IN ({_BATCH})) n
    LEFT JOIN (SELECT e.vec_id, f.person_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], f.vector::DOUBLE[]) DESC, f.id) AS rn, list_cosine_similarity(e.embedding::DOUBLE[], f.vector::DOUBLE[]) AS score
        FROM embeddings e JOIN faces f ON f.person_id IS NOT NULL WHERE e.vec_id IN ({_BATCH})) b ON b.vec_id = n.media_item_id AND b.rn = 1 AND b.score >= 0.42""",
)
def _(v):
    catalog = _catalog(v, faces=v.faces.drop("vector"), people=v.people, embeddings=_face_vectors(v), media_items=v.media.drop("content"))
    batch = v.media.where("camera_make = 'NIKON'").select("id")
    found = v.vectors.join(batch, "id", "left_semi").select("media_item_id", *[F.lit(1.0).alias(c) for c in ("x", "y", "width", "height", "confidence")], "vector")
    catalog.replace_faces(batch, found, now=_NOW)
    return catalog.read("faces").select("id", "media_item_id", "person_id")


class _OneFace:
    """A face in each file that holds anything; an empty file is an error."""

    def faces(self, content: bytes) -> list[tuple]:
        if not content:
            raise ValueError("empty file")
        return [(0.0, 0.0, 0.5, float(len(content) % 7), 0.9, [1.0, float(len(content))])]


@query(
    "update_faces",
    f"SELECT row_number() OVER (ORDER BY id) AS id, id AS media_item_id, CAST(1 AS DOUBLE) AS width, CAST(greatest(octet_length(encode(content)) % 7, 1) AS DOUBLE) AS height FROM media WHERE {_LISTED} AND NOT missing AND media_type = 'image' AND content <> ''",
)
def _(v):
    catalog = _catalog(v, media_items=v.media.drop("content"))
    catalog.update_faces(v.media.select("path", F.col("content").cast("binary").alias("content")), _OneFace, now=_NOW)
    return catalog.read("faces").select("id", "media_item_id", "width", "height")


# --- embeddings

_REPLACED = """SELECT id, media_item_id, model, round(vector[1]::DOUBLE, 5) AS first FROM vectors WHERE model = 'odd' UNION ALL
    SELECT (SELECT max(id) FROM vectors) + row_number() OVER (ORDER BY media_item_id), media_item_id, model, round(vector[64]::DOUBLE, 5) FROM vectors WHERE model = 'even'"""


@query("replace_embeddings", _REPLACED)
def _(v):
    catalog = _catalog(v, embeddings=v.vectors, media_items=v.media.drop("content"))
    catalog.replace_embeddings(v.vectors.where("model = 'even'").select("media_item_id", "model", F.reverse("vector").alias("vector")), _NOW)
    return catalog.read("embeddings").select("id", "media_item_id", "model", F.round(F.col("vector")[0].cast("double"), 5).alias("first"))


@query("update_embeddings", f"SELECT count(*) FILTER (content <> '') AS embedded, count(*) FILTER (coalesce(content, '') = '') AS skipped, count(*) FILTER (content <> '') AS stored FROM media WHERE {_LISTED} AND NOT missing")
def _(v):
    catalog = _catalog(v, media_items=v.media.drop("content"))
    done = catalog.update_embeddings(v.media.select("path", F.col("content").cast("binary").alias("content")), kernels.provider("local"), now=_NOW)
    if done["error"]:
        raise RuntimeError(done["error"])
    return catalog.read("embeddings").agg(F.lit(done["embedded"]).cast("bigint").alias("embedded"), F.lit(done["skipped"]).cast("bigint").alias("skipped"), F.count("*").alias("stored"))


@query("embedding_counters", "SELECT count(*) FILTER (content <> '' AND media_type = 'image') AS embedded, count(*) FILTER (coalesce(content, '') = '' OR media_type = 'video') AS skipped FROM media")
def _(v):
    mime = F.when(F.col("media_type") == "image", F.lit("image/jpeg")).otherwise(F.lit("audio/wav"))
    made = kernels.embed_files(v.media.select("id", F.col("content").cast("binary").alias("content"), mime.alias("mime")), kernels.provider("local"))
    return kernels.embedding_counters(made)


@query("models", "SELECT model, CASE model WHEN 'hash' THEN 'local' END AS provider, count(*) AS vectors FROM (SELECT CASE model WHEN 'even' THEN 'hash' ELSE model END AS model FROM vectors) GROUP BY model")
def _(v):
    """The models of the catalog's vectors, and who provides them."""
    known = v.spark.createDataFrame(kernels.list_models("local"), "provider string, model string")
    used = v.vectors.select(F.when(F.col("model") == "even", "hash").otherwise(F.col("model")).alias("model"))
    return used.groupBy("model").agg(F.count("*").alias("vectors")).join(known, "model", "left").select("model", "provider", "vectors")


@query("semantic_text", f"SELECT v.media_item_id AS id, round(list_cosine_similarity(vector::DOUBLE[], q), 6) AS score FROM vectors v, {_Q} JOIN media m ON m.id = v.media_item_id WHERE v.model = 'even' AND {_LISTED} ORDER BY list_cosine_similarity(vector::DOUBLE[], q) DESC, v.media_item_id LIMIT 20")
def _(v):
    return vector_search.search_semantic_text(v.media, v.vectors, "a beach", lambda _: _seed(v), "even", 20).select("id", F.round("score", 6).alias("score"))


@query("semantic_text_without_vectors", f"SELECT v.media_item_id AS id, round(list_cosine_similarity(vector::DOUBLE[], q), 6) AS score FROM vectors v, {_Q} JOIN media m ON m.id = v.media_item_id WHERE v.model = 'odd' AND {_LISTED} ORDER BY list_cosine_similarity(vector::DOUBLE[], q) DESC, v.media_item_id LIMIT 20")
def _(v):
    """Of two models, the one without a vector is not asked to embed the text and adds nothing."""

    def never(_):
        raise AssertionError("embedded")

    hits = [vector_search.search_semantic_text(v.media, v.vectors, "a beach", e, m, 20) for e, m in ((never, "none"), (lambda _: _seed(v), "odd"))]
    return hits[0].unionAll(hits[1]).select("id", F.round("score", 6).alias("score"))


@query("scores_of_one_size", f"SELECT id, round(list_cosine_similarity(vector::DOUBLE[], q), 6) AS score FROM vectors, {_Q} WHERE model = 'even'")
def _(v):
    mixed = v.vectors.withColumn("vector", F.when(F.col("model") == "even", F.col("vector")).otherwise(F.slice("vector", 1, 32)))
    return vector_search.scores(mixed, _seed(v), "id").select("id", F.round("score", 6).alias("score"))


_SAME_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(vector[i] AS DOUBLE) * q[i])) / sqrt(list_sum(list_transform(vector::DOUBLE[], lambda x: x * x)) * list_sum(list_transform(q, lambda x: x * x)))"


@query("cosine_f32", f"SELECT id, round({_SAME_DOT}, 3) AS score FROM vectors, {_Q}")
def _(v):
    q = F.array(*[F.lit(x).cast("float") for x in _seed(v)])
    return v.vectors.select("id", F.round(vectors.cosine_f32(F.col("vector"), q).cast("double"), 3).alias("score"))


@query("vector_codec", "SELECT id, CAST(256 AS INTEGER) AS bytes, 64 AS numbers, CAST(vector[1] AS DOUBLE) AS first, CAST(vector[64] AS DOUBLE) AS last FROM vectors")
def _(v):
    blob = v.vectors.select("id", vectors.vector_blob(F.col("vector")).alias("blob"))
    read = blob.select("id", F.length("blob").alias("bytes"), vectors.parse_blob(F.col("blob")).alias("v"))
    return read.select("id", "bytes", F.size("v").alias("numbers"), F.col("v")[0].cast("double").alias("first"), F.col("v")[63].cast("double").alias("last"))


@query("compact_vectors", "SELECT id, model, CAST(vector[2] AS DOUBLE) AS second FROM vectors")
def _(v):
    text = v.vectors.where("model = 'odd'").select("id", F.to_json("vector").cast("binary").alias("blob"))
    blob = v.vectors.where("model = 'even'").select("id", vectors.vector_blob(F.col("vector")).alias("blob"))
    catalog = _catalog(v, embeddings=v.vectors.drop("vector"))
    catalog.compact_vectors(text.unionAll(blob))
    return catalog.read("embeddings").select("id", "model", F.get("vector", F.lit(1)).cast("double").alias("second"))


@query("l2_vectors", "SELECT id, round(vector[3]::DOUBLE / sqrt(list_sum(list_transform(vector::DOUBLE[], lambda x: x * x))), 3) AS third FROM vectors")
def _(v):
    return v.vectors.select("id", F.round(vectors.l2_normalize(F.col("vector"))[2].cast("double"), 3).alias("third"))


@query("vector_file", "SELECT CAST(n_nationkey AS INTEGER) AS position, CAST(n_nationkey AS DOUBLE) AS a, CAST(n_regionkey AS DOUBLE) + 0.5 AS b FROM nation")
def _(v):
    path = fresh_path(v.spark, "vectors")
    pairs = F.array_sort(F.collect_list(F.array(F.col("n_nationkey").cast("double"), F.col("n_regionkey") + F.lit(0.5))))
    v.table("nation").agg(F.to_json(F.struct(F.struct(pairs.alias("embeddings")).alias("data")))).coalesce(1).write.text(path)
    return files.load_vectors(v.spark, path).select("position", F.col("vector")[0].cast("double").alias("a"), F.col("vector")[1].cast("double").alias("b"))


# --- hashes of images made from vectors

_PX = "list_transform(embedding, lambda x: CAST(least(greatest(floor(CAST(x AS DOUBLE) * 400 + 128), 0), 255) AS HUGEINT))"


def _pgm(px: Column, width: int, height: int) -> Column:
    """A grey image from an array of numbers."""
    grey = F.transform(px, lambda x: F.lpad(F.hex(F.least(F.greatest(F.floor(x.cast("double") * 400 + 128), F.lit(0)), F.lit(255)).cast("int")), 2, "0"))
    return F.unhex(F.concat(F.hex(F.lit(f"P5 {width} {height} 255\n")), F.array_join(grey, "")))


def _images(v: Views, width: int) -> DataFrame:
    e = F.col("embedding")
    px = e if width == 8 else F.concat(e, F.slice(e, 1, 8))
    return v.table("embeddings").select(F.col("vec_id").cast("string").alias("path"), _pgm(px, width, 8).alias("content"))


@query("average_hashes", f"SELECT CAST(vec_id AS VARCHAR) AS path, CAST(8 AS BIGINT) AS width, lower(lpad(to_hex(CAST(list_reduce(list_transform(px, lambda x: CAST(x * 64 >= list_sum(px) AS HUGEINT)), lambda a, b: a * 2 + b) AS UBIGINT)), 16, '0')) AS ahash FROM (SELECT vec_id, {_PX} AS px FROM embeddings)")
def _(v):
    return kernels.fingerprints(_images(v, 8)).select("path", "width", "ahash")


@query("difference_hashes", f"SELECT CAST(vec_id AS VARCHAR) AS path, lower(lpad(to_hex(CAST(list_reduce(list_transform(list_filter(range(1, 72), lambda i: i % 9 <> 0), lambda i: CAST(px[i + 1] > px[i] AS HUGEINT)), lambda a, b: a * 2 + b) AS UBIGINT)), 16, '0')) AS dhash FROM (SELECT vec_id, list_concat({_PX}, {_PX}[1:8]) AS px FROM embeddings)")
def _(v):
    return kernels.fingerprints(_images(v, 9)).select("path", "dhash")


_SQUARE = "list_transform(range(0, 1024), lambda k: CAST(least(greatest(floor(CAST(embedding[((k // 32) * 7 + (k % 32) * 3) % 64 + 1] AS DOUBLE) * 300 + 100) + ((k // 32) * (k // 32) * 13 + (k % 32) * 11) % 50, 0), 255) AS DOUBLE))"
_WAVES = "list_transform(range(0, 256), lambda k: cos((2 * (k % 32) + 1) * (k // 32) * pi() / 64) * CASE WHEN k < 32 THEN sqrt(1 / 32) ELSE sqrt(2 / 32) END)"


@query(
    "frequency_hashes",
    f"""WITH w AS (SELECT {_WAVES} AS w), i AS (SELECT vec_id, {_SQUARE} AS px FROM embeddings),
    c AS (SELECT vec_id, list_transform(range(0, 64), lambda q: list_sum(list_transform(range(0, 1024), lambda k: px[k + 1] * w[(q // 8) * 32 + k // 32 + 1] * w[(q % 8) * 32 + k % 32 + 1]))) AS c FROM i, w)
    SELECT CAST(vec_id AS VARCHAR) AS path, lower(lpad(to_hex(CAST(list_reduce(list_transform(c, lambda x: CAST(x >= list_sort(c[2:64])[32] AS HUGEINT)), lambda a, b: a * 2 + b) AS UBIGINT)), 16, '0')) AS phash FROM c""",
)
def _(v):
    k = F.col("k")
    row, column = F.floor(k / 32).cast("int"), k % 32
    cell = F.floor(F.element_at("embedding", (row * 7 + column * 3) % 64 + 1).cast("double") * 300 + 100) + (row * row * 13 + column * 11) % 50
    byte = F.struct(k.alias("k"), F.lpad(F.hex(F.least(F.greatest(cell, F.lit(0)), F.lit(255)).cast("int")), 2, "0").alias("x"))
    cells = v.table("embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(1023))).alias("k")).select("vec_id", byte.alias("b"))
    grey = F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["x"]), "")  # 1024 cells an image
    made = cells.groupBy("vec_id").agg(grey.alias("grey")).select(F.col("vec_id").cast("string").alias("path"), F.unhex(F.concat(F.hex(F.lit("P5 32 32 255\n")), "grey")).alias("content"))
    return kernels.fingerprints(made).select("path", "phash")


def _hash_of(content: bytes) -> np.ndarray:
    return kernels.bounded_width(kernels.read_image(content), 6)


@query("fingerprints")
def _(v):
    """All three hashes of narrowed images; tested against definitions written cell by cell."""
    return kernels.fingerprints(_images(v, 9), _hash_of).select("path", "width", "height", "ahash", "dhash", "phash")


# --- files

_BELOW = "string_split(substring(path, 6), '/')"
_NAMES = "('" + "','".join(rules.EXCLUDED_NAMES) + "')"
_BAD = lambda parts: f"len(list_filter({parts}, lambda p: starts_with(p, '.') OR lower(p) IN {_NAMES})) > 0"
_IMAGE = "('" + "','".join(rules.IMAGE_EXTENSIONS) + "')"
_EXT = "lower(regexp_extract(path, '\\.([^./]*)$', 1))"
_EMPTY = "used AS MATERIALIZED (SELECT parent AS path FROM entries UNION SELECT path FROM entries WHERE error IS NOT NULL), hollow AS MATERIALIZED (SELECT e.path FROM entries e ANTI JOIN used u ON u.path = e.path WHERE e.is_dir AND e.error IS NULL)"
_TILE = f"(starts_with(lower(regexp_extract(path, '[^/]*$')), 'facetile') AND {_EXT} IN {_IMAGE})"


@query("discovered_files", f"SELECT path, regexp_extract(path, '[^/]*$') AS file_name, {_EXT} AS extension, size_bytes, CAST({_NOW} AS BIGINT) AS imported_at FROM entries WHERE NOT is_dir AND error IS NULL AND NOT {_BAD(_BELOW)} AND NOT {_TILE}")
def _(v):
    return files.media_files(v.entries, _NOW).select("path", "file_name", "extension", "size_bytes", "imported_at")


@query("ignored_files", f"SELECT path, size_bytes, CASE WHEN {_BAD(_BELOW + '[1:-2]')} THEN 'Inside folder ignored by indexing rules' ELSE 'Facetile image ignored by indexing rules' END AS reason FROM entries WHERE NOT is_dir AND error IS NULL AND ({_BAD(_BELOW)} OR {_TILE})")
def _(v):
    return files.ignored_files(v.entries)


@query("empty_folders", f"WITH {_EMPTY} SELECT path, CAST(len(string_split(path, '/')) AS INTEGER) AS depth FROM hollow")
def _(v):
    return files.empty_folders(v.entries).select("path", F.size(F.split("path", "/")).alias("depth"))


@query("listing_errors", "SELECT path, error FROM entries WHERE error IS NOT NULL")
def _(v):
    return files.errors(v.entries)


_PIECES = ", ".join(f"CAST(('0x' || substr(h, {15 * k + 1}, 15)) AS BIGINT) AS s{k}" for k in range(4))
_SUMS = ", ".join(f"sum(s{k}) AS s{k}" for k in range(4))
_SHA = "sha256(" + " || ',' || ".join(f"CAST(CAST(coalesce(s{k}, 0) AS HUGEINT) AS VARCHAR)" for k in range(4)) + ")"
_PARENT = "regexp_replace(path, '/[^/]*$', '')"


def _level(d: int) -> str:
    """Folders with ``d`` slashes, from those below."""
    below = f" UNION ALL SELECT path, n, s0, s1, s2, s3 FROM below{d + 1}" if d < 6 else ""
    return f"""level{d} AS MATERIALIZED (SELECT f.path, n_files, own, {_SHA} AS digest FROM (SELECT path, own FROM folders WHERE depth = {d}) f
        LEFT JOIN (SELECT path, CAST(sum(n) AS BIGINT) AS n_files, {_SUMS} FROM (SELECT path, n, s0, s1, s2, s3 FROM direct{below}) GROUP BY path) c ON c.path = f.path),
    below{d} AS (SELECT {_PARENT} AS path, n, {_PIECES} FROM (SELECT path, n_files AS n, sha256('d/' || regexp_extract(path, '[^/]*$') || '/' || digest) AS h FROM level{d}))"""


@query(
    "folder_digests",
    f"""WITH leaves AS (SELECT parent AS path, sha256('f/' || regexp_extract(path, '[^/]*$') || '/' || coalesce(CAST(size_bytes AS VARCHAR), '') || '/' || coalesce(CAST(modified_at AS VARCHAR), '') || '/' || coalesce(error, '')) AS h
        FROM entries WHERE NOT is_dir OR error IS NOT NULL),
    direct AS MATERIALIZED (SELECT path, count(*) AS n, {_SUMS} FROM (SELECT path, {_PIECES} FROM leaves) GROUP BY path),
    named AS (SELECT parent AS path FROM entries UNION SELECT path FROM entries WHERE is_dir AND error IS NULL),
    up AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:k], '/') AS path FROM named, LATERAL (SELECT unnest(range(2, len(string_split(path, '/')) + 1)) AS k)),
    folders AS MATERIALIZED (SELECT u.path, len(string_split(u.path, '/')) - 1 AS depth, {_SHA} AS own FROM up u LEFT JOIN direct d ON d.path = u.path),
    {", ".join(_level(d) for d in range(6, 0, -1))}
    {" UNION ALL ".join(f"SELECT path, CAST({d} AS INTEGER) AS depth, coalesce(n_files, 0) AS n_files, own, digest FROM level{d}" for d in range(1, 7))}""",
)
def _(v):
    return tree.folder_digests(v.entries)


@query("rescan_diff", f"SELECT * FROM ({_DIFF})")
def _(v):
    """What changed since the last scan, compared only in folders whose digests differ."""
    listed = lambda rows: tree.folder_digests(rows.select(F.lit("/lib").alias("root"), "path", tree.folder_of().alias("parent"), F.lit(False).alias("is_dir"), "size_bytes", "modified_at", F.lit(None).cast("string").alias("error")))
    media = v.media.where("not missing").select("path", "size_bytes", "modified_at", "missing")
    changed = tree.changed_folders(listed(media), listed(v.listing))
    return tree.rescan_diff(v.listing, media, changed).select("path", "size_bytes", "action")


_NONE = "__HIVE_DEFAULT_PARTITION__"
_BRANCH = f"'source=' || coalesce(nullif(source, ''), '{_NONE}')"


@query("folder_source", f"SELECT DISTINCT {_BRANCH} AS folder, false AS has_files FROM documents UNION ALL SELECT DISTINCT {_BRANCH} || '/lang=' || coalesce(nullif(lang, ''), '{_NONE}'), true FROM documents")
def _(v):
    """Folders of a tree of real files, which Spark wrote, and whether they hold some."""
    root = fresh_path(v.spark, "tree")
    v.table("documents").select(F.col("doc_id").cast("string").alias("value"), "source", "lang").write.partitionBy("source", "lang").text(root)
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    folders.register(v.spark)
    found = v.spark.read.format("media_folders").load(root).where("not excluded and error is null")
    below = F.substring(F.when(F.col("is_dir"), F.col("path")).otherwise(F.col("parent")), len(root) + 2, 1 << 20)
    return found.groupBy(below.alias("folder")).agg(F.max(~F.col("is_dir")).alias("has_files")).where("folder <> ''")


@query("clean_paths", "SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'C:\\' || source ELSE 'D:\\' || coalesce(source, '') END AS path FROM documents")
def _(v):
    raw = F.when(F.col("lang") == "en", F.concat(F.lit("\\\\?\\C:\\"), "source")).otherwise(F.concat(F.lit("D:\\"), F.coalesce("source", F.lit(""))))
    return v.table("documents").select(F.col("doc_id").alias("id"), rules.clean_path(raw).alias("path"))


@query("conversion_keys", "SELECT id, sha256(path || '|' || coalesce(CAST(size_bytes AS VARCHAR), '') || '|' || coalesce(CAST(modified_at AS VARCHAR), '')) AS key FROM media")
def _(v):
    return v.media.select("id", files.conversion_key(F.col("path"), F.col("size_bytes"), F.col("modified_at")).alias("key"))


@query("display_paths", "SELECT id, CASE WHEN NOT missing AND path LIKE '%.HEIC' THEN path || '.jpg' END AS display_path, CASE WHEN path LIKE '%.HEIC' THEN path || '.jpg' ELSE path END AS shown_path FROM media")
def _(v):
    made = v.media.where("path LIKE '%.HEIC'").select("path", F.concat("path", F.lit(".jpg")).alias("converted"))
    both = files.shown_paths(files.display_paths(v.media.select("id", "path", "missing"), made).withColumnRenamed("display_path", "first"), made)
    return both.select("id", F.col("first").alias("display_path"), F.col("display_path").alias("shown_path"))


def _le32(x: Column) -> Column:
    h = F.lpad(F.hex(x.cast("bigint")), 8, "0")
    return F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])


def _exif(doc: Column, make: Column) -> Column:
    """A TIFF block with a camera, a date and a place that follow from an id."""

    def tag(number: int, kind: int, count: int, value: int) -> str:
        return (number.to_bytes(2, "little") + kind.to_bytes(2, "little") + count.to_bytes(4, "little") + value.to_bytes(4, "little")).hex()

    when = F.timestamp_seconds(946684800 + (doc % 5000) * 86400 + doc % 86400)
    date = F.when(doc % 7 == 0, F.rpad(F.lit("some day"), 19, ".")).when(doc % 2 == 0, F.date_format(when, "yyyy:MM:dd HH:mm:ss")).otherwise(F.date_format(when, "yyyy-MM-dd HH:mm:ss"))
    one = _le32(F.lit(1))
    rational = lambda *parts: F.concat(*[F.concat(_le32(p), one) for p in parts])
    main = "0400" + tag(0x010F, 2, 6, 62) + tag(0x0110, 2, 8, 68) + tag(0x8769, 4, 1, 76) + tag(0x8825, 4, 1, 114) + "00000000"
    inner = "0100" + tag(0x9003, 2, 20, 94) + "00000000"
    ref = F.when(doc % 3 == 0, F.lit("53")).otherwise(F.lit("4E"))
    place = F.concat(F.lit("0400" + tag(1, 2, 2, 0)[:16]), ref, F.lit("000000" + tag(2, 5, 3, 168) + tag(3, 2, 2, ord("E")) + tag(4, 5, 3, 192) + "00000000"))
    text = lambda c: F.concat(F.hex(c), F.lit("00"))
    model = F.concat(F.lit("Model "), (doc % 5).cast("string"))
    return F.unhex(F.concat(F.lit("49492A0008000000" + main), text(make), text(model), F.lit(inner), text(date), place, rational(doc % 90, doc % 60, F.lit(36)), rational(doc % 180, F.lit(30), F.lit(0))))


@query(
    "exif_tags",
    """SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'NIKON' ELSE 'Canon' END AS camera_make, 'Model ' || (doc_id % 5) AS camera_model,
    CASE WHEN doc_id % 7 <> 0 THEN 946684800 + (doc_id % 5000) * 86400 + doc_id % 86400 END AS captured_at,
    round((doc_id % 90 + (doc_id % 60) / 60 + 0.01) * CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 1 END, 6) AS latitude, round(doc_id % 180 + 0.5, 6) AS longitude FROM documents""",
)
def _(v):
    make = F.when(F.col("lang") == "en", F.lit("NIKON")).otherwise(F.lit("Canon"))
    made = v.table("documents").select(F.col("doc_id").cast("string").alias("path"), _exif(F.col("doc_id"), make).alias("content"))
    found = files.with_exif(made)
    return found.select(F.col("path").cast("bigint").alias("id"), "camera_make", "camera_model", "captured_at", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


# --- search

@query("form_search", f"SELECT {_COLUMNS} FROM media WHERE {_LISTED} AND media_type = 'image' AND {_DATE} BETWEEN 1577836800 AND 1640995199 AND camera_make || ' ' || camera_model ILIKE '%canon%' {_DESC} LIMIT 120")
def _(v):
    f = SearchFilter.from_form({"media_type": "image", "from": "2020-01-01", "to": "2021-12-31", "camera": "canon", "query": ""})
    return _ids(filters.search_media(v.media, f))


@query("radius_that_is_none", f"SELECT {_COLUMNS} FROM media WHERE {_LISTED} {_DESC} LIMIT 100")
def _(v):
    assert not geo.valid(95.0, 20.0, 10.0)
    return _ids(filters.search_media(v.media, SearchFilter(lat=95.0, lng=20.0, radius_km=10.0)))


@query("page_after", f"SELECT {_COLUMNS} FROM media WHERE {_LISTED} {_DESC} LIMIT 40 OFFSET 60")
def _(v):
    rows = filters.matching(v.media, SearchFilter())
    last = filters.page(rows, limit=60).select("id", F.coalesce("captured_at", "modified_at", "created_at").alias("ts")).collect()[-1]  # one page
    return _ids(filters.page_after(rows, last["ts"], last["id"], 40))


@query("hits_by_date", f"SELECT * FROM (SELECT m.id, m.path, {_DATE} AS sort_ts FROM vectors v, {_Q} JOIN media m ON m.id = v.media_item_id WHERE {_LISTED} ORDER BY list_cosine_similarity(vector::DOUBLE[], q) DESC, v.media_item_id LIMIT 50) ORDER BY sort_ts DESC NULLS LAST, id DESC LIMIT 30")
def _(v):
    return _ids(filters.page(vector_search.search_semantic(v.media, v.vectors, _seed(v)), limit=30))


@query("cleanup_scope_listed", f"SELECT id, path FROM media WHERE {_LISTED} AND NOT missing AND media_type = 'image' AND path IN (SELECT path FROM listing)")
def _(v):
    return filters.cleanup_scope(v.media, v.listing).select("id", "path")


# --- caches and plans

@query(
    "backfill_cache",
    """SELECT media_item_id, processor, model, processed_at FROM (SELECT media_item_id, processor, model, CAST(NULL AS BIGINT) AS processed_at FROM processing
    UNION ALL SELECT v.media_item_id, 'embeddings', v.model, 5 FROM vectors v JOIN media m ON m.id = v.media_item_id
    UNION ALL SELECT DISTINCT f.media_item_id, 'faces', 'insightface-buffalo_l', 7 FROM faces f JOIN media m ON m.id = f.media_item_id)""",
)
def _(v):
    catalog = _catalog(
        v, media_processing_cache=v.processing, media_items=v.media.drop("content"), embeddings=v.vectors.withColumn("created_at", F.lit(5)), faces=v.faces.drop("vector").withColumn("created_at", F.lit(7))
    )
    catalog.backfill()
    catalog.backfill()  # again changes nothing
    return catalog.read("media_processing_cache").select("media_item_id", "processor", "model", "processed_at")


@query(
    "upsert_cleanup_cache",
    """SELECT coalesce(m.path, c.path) AS path, coalesce(sha256(m.content), c.sha256) AS sha256,
        CASE WHEN m.path IS NULL OR (m.size_bytes IS NOT DISTINCT FROM c.size_bytes AND m.modified_at IS NOT DISTINCT FROM c.modified_at) THEN c.ahash END AS ahash
    FROM (SELECT * FROM media WHERE media_type = 'image') m FULL JOIN cleanup c ON c.path = m.path""",
)
def _(v):
    catalog = _catalog(v, cleanup_file_cache=v.cleanup)
    updates = v.media.where("media_type = 'image'").select("path", "size_bytes", "modified_at", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    both = v.media.select("path", "size_bytes", "modified_at", F.lit("x").alias("sha256"), F.lit("y").alias("ahash"))  # both halves at once are left out
    schema = TABLES["cleanup_file_cache"]
    catalog.update_cleanup_cache(_as(updates, schema, updated_at=_NOW).unionAll(_as(both, schema, updated_at=_NOW)))
    return catalog.read("cleanup_file_cache").select("path", "sha256", "ahash")


@query("clear_cleanup_cache", "SELECT count(*) AS cleared, CAST(0 AS BIGINT) AS remaining FROM cleanup")
def _(v):
    catalog = _catalog(v, cleanup_file_cache=v.cleanup)
    n = catalog.clear_cleanup_cache()
    return catalog.read("cleanup_file_cache").agg(F.lit(n).cast("bigint").alias("cleared"), F.count("*").alias("remaining"))


@query("library_folders", "SELECT row_number() OVER (ORDER BY path) AS id, path FROM (SELECT DISTINCT '/lib/' || source AS path FROM documents WHERE source IS NOT NULL) UNION ALL SELECT 1 + count(DISTINCT source), '/zz' FROM documents")
def _(v):
    catalog = _catalog(v)
    sources = [r["source"] for r in v.table("documents").where("source is not null").select("source").distinct().collect()]  # folders that a user adds
    catalog.update_settings([f"/lib/{s}" for s in sources])
    catalog.add_library_folder("/zz", is_dir=lambda _: True)
    catalog.add_library_folder("/zz", is_dir=lambda _: True)
    catalog.add_library_folder("/gone", is_dir=lambda _: True)
    catalog.remove_library_folder("/gone")
    return catalog.list_library_folders().select("id", "path")


_SCOPE = f"SELECT * FROM ({_FILES}) f WHERE path IN (SELECT path FROM media WHERE {_LISTED})"
_PLAN = f"""x AS (SELECT *, count(*) OVER (PARTITION BY sha256) AS n, row_number() OVER ({_KEEP}) AS rn, first_value(path) OVER ({_KEEP}) AS keep_path FROM ({_SCOPE})),
    g AS (SELECT keep_path, 'exact-' || row_number() OVER (ORDER BY keep_path) AS group_id FROM x WHERE rn = 1 AND n > 1),
    w AS (SELECT x.*, c.ahash, c.phash, c.dhash, left(c.phash, 1) AS far FROM x JOIN cleanup c ON c.path = x.path AND c.size_bytes IS NOT DISTINCT FROM x.size_bytes AND c.modified_at IS NOT DISTINCT FROM x.modified_at WHERE n = 1 AND c.ahash IS NOT NULL),
    k AS (SELECT first_value(path) OVER (PARTITION BY ahash, far ORDER BY coalesce({_DATE}, 9223372036854775807), coalesce(size_bytes, 0) DESC, path) AS keep_path, path, size_bytes,
        count(*) OVER (PARTITION BY ahash, far) AS m, bit_count(xor(('0x' || phash)::UBIGINT, ('0x' || arg_min(phash, path) OVER (PARTITION BY ahash, far))::UBIGINT)) AS bits, ahash, far FROM w),
    members AS (SELECT group_id, 'exact-image' AS kind, x.path, x.size_bytes, x.keep_path, CAST(NULL AS INTEGER) AS score FROM x JOIN g ON g.keep_path = x.keep_path WHERE n > 1
        UNION ALL SELECT 'visual-' || dense_rank() OVER (ORDER BY keep_path), 'visual-image', path, size_bytes, keep_path, CAST(max(bits) OVER (PARTITION BY ahash, far) AS INTEGER) FROM k WHERE m > 1)"""


def _plan(v: Views) -> cleanup.CleanupPlan:
    hashes = v.media.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    return cleanup.generate(v.media, v.cleanup, files.ignored_files(v.entries), files.empty_folders(v.entries), ["/lib/"], hashes)


@query("plan_members", f"WITH {_PLAN} SELECT group_id, kind, path, keep_path, path = keep_path AS is_keeper, score FROM members")
def _(v):
    return _plan(v).members.select("group_id", "kind", "path", "keep_path", "is_keeper", "score")


_IGNORED = f"ignored AS (SELECT path, size_bytes FROM entries WHERE NOT is_dir AND error IS NULL AND ({_BAD(_BELOW)} OR {_TILE}))"


@query(
    "plan_totals",
    f"""WITH {_PLAN}, {_IGNORED}, {_EMPTY}, e AS (SELECT path, size_bytes FROM members WHERE path <> keep_path)
    SELECT (SELECT count(*) FROM ignored) AS ignored_files, CAST((SELECT sum(size_bytes) FROM ignored) AS BIGINT) AS ignored_bytes, (SELECT count(*) FROM hollow) AS empty_folders,
        (SELECT count(DISTINCT group_id) FROM members) AS duplicate_groups, (SELECT count(*) FROM e) AS duplicate_files, CAST((SELECT sum(size_bytes) FROM e) AS BIGINT) AS duplicate_bytes,
        CAST((SELECT sum(s) FROM (SELECT max(size_bytes) AS s FROM (SELECT * FROM e UNION ALL SELECT * FROM ignored) GROUP BY path)) AS BIGINT) AS distinct_bytes,
        CAST((SELECT sum(size_bytes) FROM e) + (SELECT sum(size_bytes) FROM ignored) AS BIGINT) AS total_bytes""",
)
def _(v):
    return _plan(v).totals()


@query(
    "apply_plan",
    f"""WITH {_PLAN}, {_IGNORED}, {_EMPTY}, asked AS (SELECT path FROM members WHERE path <> keep_path UNION SELECT path FROM media WHERE media_type = 'video'),
    allowed AS (SELECT path, max(coalesce(size_bytes, 0)) AS size_bytes FROM (SELECT path, size_bytes FROM members UNION ALL SELECT path, size_bytes FROM ignored) GROUP BY path)
    SELECT a.path, 'delete-file' AS action, w.path IS NOT NULL AS accepted, CASE WHEN w.path IS NOT NULL THEN 'planned' ELSE 'refusing unplanned file deletion: ' || a.path END AS reason, coalesce(w.size_bytes, 0) AS size_bytes
    FROM asked a LEFT JOIN allowed w ON w.path = a.path
    UNION ALL SELECT e.path, 'delete-folder', h.path IS NOT NULL, CASE WHEN h.path IS NOT NULL THEN 'planned' ELSE 'refusing unplanned folder deletion: ' || e.path END, 0
    FROM entries e LEFT JOIN hollow h ON h.path = e.path WHERE e.is_dir AND e.error IS NULL""",
)
def _(v):
    plan = _plan(v)
    book = cleanup.PlanBook()
    remove = plan.members.where("not is_keeper").select("path").unionAll(v.media.where("media_type = 'video'").select("path"))
    manifest = book.apply(book.add(plan), remove, v.entries.where("is_dir and error is null").select("path"), v.entries.select("path", "parent"))
    return cleanup.execute(manifest).select("path", "action", "accepted", "reason", "size_bytes")


@query("mark_processed", "SELECT media_item_id, processor, model, size_bytes FROM processing WHERE media_item_id NOT IN (SELECT id FROM media WHERE media_type = 'video') UNION ALL SELECT id, 'embeddings', 'clip', size_bytes FROM media WHERE media_type = 'video'")
def _(v):
    cache = _as(v.processing, TABLES["media_processing_cache"])
    done = incremental.mark_processed(cache, v.media, v.media.where("media_type = 'video'"), "embeddings", "clip", _NOW)
    return done.select("media_item_id", "processor", "model", "size_bytes")


# --- streams

@query(
    "ingest_stream",
    """SELECT coalesce(m.id, (SELECT max(id) FROM media) + row_number() OVER (PARTITION BY m.id IS NULL ORDER BY l.path)) AS id, l.path, l.size_bytes,
        CASE WHEN m.id IS NOT NULL THEN 1500000000 ELSE 1800000000 END AS imported_at FROM listing l LEFT JOIN media m ON m.path = l.path
    UNION ALL SELECT id, path, size_bytes, 1500000000 FROM media WHERE path NOT IN (SELECT path FROM listing)""",
)
def _(v):
    """Two sources with streams of their own; each is run again with nothing new."""
    listing, new = v.listing, F.col("path").endswith(".new.jpg")
    catalog = _catalog(v, media_items=v.media.drop("content").withColumn("imported_at", F.lit(1500000000)))
    sources, streams = [fresh_path(v.spark, "listings") for _ in range(2)], [fresh_path(v.spark, "stream") for _ in range(2)]
    for source, rows in zip(sources, (listing.where(~new), listing.where(new)), strict=True):
        rows.write.parquet(f"{source}/1")
    for source, stream in [*zip(sources, streams, strict=True)] * 2:
        ingest.ingest_listings(catalog, f"{source}/*", listing.schema, stream)
    return catalog.read("media_items").select("id", "path", "size_bytes", "imported_at")


@query("stream_progress", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, max(event_id) AS last_id FROM events GROUP BY event_type")
def _(v):
    """Run again from the same checkpoint, which has nothing new."""
    events, checkpoint = v.table("events").select("event_id", "event_type", "user_id"), fresh_path(v.spark, "stream")
    for _ in range(2):
        counted = ingest.stream_progress(v.spark, f"{v.directory}/event[s].parquet", events.schema, checkpoint)
    return counted
