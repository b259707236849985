"""Queries over the catalog's operators, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediashoal.functions import dates, rules, vectors
from mediashoal.operators import clusters, duplicates, incremental, people, pivots, vector_search
from mediashoal.plans import filters
from mediashoal.plans.clustered import Clustered, near_centres
from mediashoal.plans.filters import SearchFilter
from mediashoal.storage import fresh_path
from mediashoal.views import Views, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_DATE = "coalesce(captured_at, modified_at, created_at)"
_LISTED = (
    " AND ".join(f"lower(path) NOT LIKE '%{n}%'" for n in rules.EXCLUDED_NAMES) + " AND file_name NOT LIKE '.%' AND (media_type <> 'image' OR lower(file_name) NOT LIKE 'facetile%')"
)
_DESC, _ASC = f"ORDER BY {_DATE} DESC NULLS LAST, id DESC", f"ORDER BY {_DATE} ASC NULLS FIRST, id ASC"
#: A fixed query vector: the one with id 7.
_SEED = 7


def query(name: str, sql: str | None = None):
    """Registers ``f(views)`` under a name, with its SQL over tables and views."""

    def add(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, directory: f(Views(spark, directory))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return add


def _ids(df: DataFrame) -> DataFrame:
    return df.select("id", "path", dates.sort_ts().alias("sort_ts"))


_COLUMNS = f"id, path, {_DATE} AS sort_ts"


def _search(name: str, f: SearchFilter, where: str, order: str = _DESC, limit: int = 100, offset: int = 0) -> None:
    sql = f"SELECT {_COLUMNS} FROM media WHERE {_LISTED} AND {where} {order} LIMIT {limit} OFFSET {offset}"
    query(name, sql)(lambda v: _ids(filters.search_media(v.media, f, v.faces, v.people)))


_search("media_search_text", SearchFilter(query=" img_1_3 "), "(file_name ILIKE '%img_1_3%' OR path ILIKE '%img_1_3%')")
_search("media_search_type", SearchFilter(media_type="video", missing=False, limit=20), "media_type = 'video' AND NOT missing", limit=20)
_search("media_search_dates", SearchFilter(from_ts=1590000000, to_ts=1620000000, sort_order="ASC", limit=500), f"{_DATE} BETWEEN 1590000000 AND 1620000000", _ASC, 500)
_search("media_search_camera", SearchFilter(camera="nikon model 3"), "(camera_make || ' ' || camera_model ILIKE '%nikon model 3%' OR camera_model ILIKE '%nikon model 3%')")
_search("media_search_gps", SearchFilter(has_gps=False, limit=500), "(latitude IS NULL OR longitude IS NULL)", limit=500)
_search("media_search_no_camera", SearchFilter(has_camera=False), "camera_make IS NULL AND camera_model IS NULL")
_search("media_search_has_camera", SearchFilter(has_camera=True, limit=9999), "(camera_make IS NOT NULL OR camera_model IS NOT NULL)", limit=500)
_search("media_search_page_asc", SearchFilter(sort_order="asc", limit=50, offset=30), "true", _ASC, 50, 30)
_search("media_search_page_desc", SearchFilter(limit=0, offset=-4), "true", _DESC, 1, 0)

_HAVERSINE = "2 * 6371.0088 * asin(sqrt(pow(sin(radians(latitude - 10) / 2), 2) + cos(radians(10)) * cos(radians(latitude)) * pow(sin(radians(longitude - 20) / 2), 2)))"
_NEAR = f"latitude BETWEEN 10 - 3000 / 111.32 AND 10 + 3000 / 111.32 AND longitude BETWEEN 20 - 3000 / (111.32 * cos(radians(10))) AND 20 + 3000 / (111.32 * cos(radians(10))) AND {_HAVERSINE} <= 3000"
_search("media_search_geo", SearchFilter(lat=10.0, lng=20.0, radius_km=3000.0, limit=40, offset=2), _NEAR, _DESC, 40, 2)
_search("media_search_person_id", SearchFilter(person_id=3), "id IN (SELECT media_item_id FROM faces WHERE person_id = 3)")
_search(
    "media_search_person_name", SearchFilter(person_name=" ION_1 ", missing=False, limit=500),
    "NOT missing AND id IN (SELECT f.media_item_id FROM faces f JOIN people p ON p.id = f.person_id WHERE p.name ILIKE '%ION_1%')", limit=500,
)


@query("geo_all_matches", f"SELECT id, round({_HAVERSINE}, 6) AS km FROM media WHERE {_LISTED} AND {_NEAR}")
def _(v):
    from mediashoal.functions.geo import haversine

    found = filters.matching(v.media, SearchFilter(lat=10.0, lng=20.0, radius_km=3000.0))
    return found.select("id", F.round(haversine(F.col("latitude"), F.col("longitude"), 10.0, 20.0), 6).alias("km"))


@query("geo_points", "SELECT id, latitude, longitude FROM media WHERE media_type = 'image' AND NOT missing AND latitude IS NOT NULL AND longitude IS NOT NULL AND lower(file_name) NOT LIKE 'facetile%'")
def _(v):
    return filters.map_points(v.media).select("id", "latitude", "longitude")


def _clustered(v: Views, by: str) -> Clustered:
    return Clustered.build(v.media.drop("content"), fresh_path(v.spark, "clustered"), by, files=24)


@query("clustered_text", f"SELECT {_COLUMNS} FROM media WHERE {_LISTED} AND (file_name ILIKE '%img_1_3%' OR path ILIKE '%img_1_3%') {_DESC} LIMIT 100")
def _(v):
    """The text search, opening only files with its trigrams."""
    return _ids(_clustered(v, "path").search(SearchFilter(query=" img_1_3 ")))


@query("clustered_geo", f"SELECT {_COLUMNS}, true AS under_half FROM media WHERE {_LISTED} AND {_NEAR} {_DESC} LIMIT 40 OFFSET 2")
def _(v):
    """The search of a circle, opening only files whose cells it covers."""
    table = _clustered(v, "place")
    found = table.search(SearchFilter(lat=10.0, lng=20.0, radius_km=3000.0, limit=40, offset=2))
    return _ids(found).withColumn("under_half", F.lit(2 * len(table.opened) < 24))


@query("clustered_page_after", f"SELECT {_COLUMNS}, true AS few FROM media WHERE {_LISTED} {_DESC} LIMIT 40 OFFSET 60")
def _(v):
    """The third page, opening only files that it is in."""
    table, size = _clustered(v, "date"), 40
    last = filters.page(filters.matching(v.media, SearchFilter()), limit=60).select("id", dates.sort_ts().alias("ts")).collect()[-1]
    found = table.page_after(SearchFilter(), last["ts"], last["id"], size)
    rows = v.media.count() / 24
    return _ids(found).withColumn("few", F.lit(len(table.opened) <= 6 * (2 + size / rows)))


_BOX_D = "c.radius / 111.32"
_BOX_W = "c.radius / (111.32 * greatest(abs(cos(radians(c.latitude))), 0.01))"
_APART = "2 * 6371.0088 * asin(sqrt(pow(sin(radians(m.latitude - c.latitude) / 2), 2) + cos(radians(c.latitude)) * cos(radians(m.latitude)) * pow(sin(radians(m.longitude - c.longitude) / 2), 2)))"


@query(
    "geo_join",
    f"""WITH c AS (SELECT id, latitude, longitude, 200 + id % 900 AS radius FROM media WHERE id % 50 = 0 AND latitude IS NOT NULL)
    SELECT c.id AS centre_id, m.id, round({_APART}, 6) AS km FROM c JOIN media m ON m.latitude BETWEEN greatest(-90, c.latitude - {_BOX_D}) AND least(90, c.latitude + {_BOX_D})
        AND (c.latitude - {_BOX_D} <= -90 OR c.latitude + {_BOX_D} >= 90 OR m.longitude BETWEEN greatest(-180, c.longitude - {_BOX_W}) AND least(180, c.longitude + {_BOX_W})) WHERE {_APART} <= c.radius""",
)
def _(v):
    """Media around many places at once."""
    radius = (200 + F.col("id") % 900).cast("double").alias("radius_km")
    centres = v.media.where("id % 50 = 0 and latitude is not null").select(F.col("id").alias("centre_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lng"), radius)
    return near_centres(v.media, centres).select("centre_id", "id", F.round("km", 6).alias("km"))


@query("get_media_item", "SELECT id, path, file_name, size_bytes FROM media WHERE id = 42")
def _(v):
    return filters.get_media_item(v.media, 42).select("id", "path", "file_name", "size_bytes")


@query("cleanup_scope", f"SELECT id, path FROM media WHERE {_LISTED} AND NOT missing AND media_type = 'image' AND (path = '/lib/src1' OR starts_with(path, '/lib/src1/'))")
def _(v):
    return filters.cleanup_scope(v.media).where(rules.under_root(F.col("path"), "/lib/src1/")).select("id", "path")


@query(
    "path_rules",
    """WITH u AS (SELECT page_id AS id, regexp_replace(url, '^[a-z]+://', '/') AS path FROM pages UNION ALL SELECT id, path FROM media),
    n AS (SELECT id, path, string_split(path, '/') AS parts FROM u), e AS (SELECT *, parts[len(parts)] AS name FROM n),
    x AS (SELECT *, lower(nullif(regexp_extract(name, '^.+\\.([^.]*)$', 1), '')) AS ext FROM e)
    SELECT id, path, ext AS extension, CASE WHEN ext IN ('"""
    + "','".join(rules.IMAGE_EXTENSIONS)
    + "') THEN 'image' WHEN ext IN ('"
    + "','".join(rules.VIDEO_EXTENSIONS)
    + """') THEN 'video' END AS media_type, len(list_filter(parts, lambda p: starts_with(p, '.') OR lower(p) IN ('"""
    + "','".join(rules.EXCLUDED_NAMES)
    + "'))) > 0 AS excluded, coalesce(ext IN ('"
    + "','".join(rules.IMAGE_EXTENSIONS)
    + "') AND starts_with(lower(name), 'facetile'), false) AS face_tile FROM x",
)
def _(v):
    paths = v.table("pages").select(F.col("page_id").alias("id"), F.regexp_replace("url", "^[a-z]+://", "/").alias("path")).unionAll(v.media.select("id", "path"))
    name = rules.file_name(F.col("path"))
    rows = paths.withColumn("name", name).withColumn("extension", rules.extension(F.col("name"))).withColumn("media_type", rules.media_type(F.col("extension")))
    return rows.select("id", "path", "extension", "media_type", rules.is_excluded(F.col("path")).alias("excluded"), rules.is_face_tile(F.col("name"), F.col("media_type")).alias("face_tile"))


@query("people_face_counts", "SELECT p.id, p.name, count(f.id) AS face_count FROM people p LEFT JOIN faces f ON f.person_id = p.id GROUP BY p.id, p.name")
def _(v):
    return people.list_people(v.people, v.faces).select("id", "name", "face_count")


@query("face_list", "SELECT f.id, f.media_item_id, f.person_id, p.name AS person_name FROM faces f LEFT JOIN people p ON p.id = f.person_id")
def _(v):
    return people.list_faces(v.faces, v.people).select("id", "media_item_id", "person_id", "person_name")


@query("face_list_of_person", "SELECT f.id, p.name AS person_name FROM faces f LEFT JOIN people p ON p.id = f.person_id WHERE f.person_id = 4")
def _(v):
    return people.list_faces(v.faces, v.people, person_id=4).select("id", "person_name")


def _seed(v: Views) -> list[float]:
    return v.table("embeddings").where(F.col("vec_id") == _SEED).first()["embedding"]


_Q = f"(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = {_SEED})"


_TOPK = f"SELECT v.media_item_id AS id, round(list_cosine_similarity(vector::DOUBLE[], q), 6) AS score FROM vectors v, {_Q} JOIN media m ON m.id = v.media_item_id WHERE {_LISTED} ORDER BY list_cosine_similarity(vector::DOUBLE[], q) DESC, v.media_item_id LIMIT 50"


@query("semantic_topk", _TOPK)
def _(v):
    return vector_search.search_semantic(v.media, v.vectors, _seed(v)).select("id", F.round("score", 6).alias("score"))


@query(
    "semantic_topk_model_named",
    f"SELECT id, score FROM (SELECT m.id, m.path, m.file_name, round(list_cosine_similarity(vector::DOUBLE[], q), 6) AS score FROM vectors v, {_Q} JOIN media m ON m.id = v.media_item_id WHERE v.model = 'odd' AND {_LISTED} ORDER BY list_cosine_similarity(vector::DOUBLE[], q) DESC, v.media_item_id LIMIT 200) WHERE contains(lower(file_name), '.mp4') OR contains(lower(path), '.mp4')",
)
def _(v):
    hits = vector_search.search_semantic(v.media, v.vectors, _seed(v), 5000, model="odd")
    return vector_search.semantic_then_name(hits, " .MP4 ").select("id", F.round("score", 6).alias("score"))


@query("cli_rank", f"SELECT v.id, round(list_cosine_similarity(vector::DOUBLE[], q), 6) AS score FROM vectors v, {_Q}")
def _(v):
    return vector_search.rank_all(v.vectors, _seed(v))


@query("semantic_topk_pruned", _TOPK)
def _(v):
    """The same from an index of the vectors by cells, of some 64 rows each."""
    index = pivots.PivotIndex.build(v.vectors, fresh_path(v.spark, "pivots"), cell_rows=64)
    return vector_search.search_semantic(v.media, None, _seed(v), index=index).select("id", F.round("score", 6).alias("score"))


_CENTRED = "SELECT vec_id AS id, label, list_transform(embedding, lambda x, i: CAST(0.3 * x::DOUBLE + CASE WHEN (i - 1) % 10 = label THEN 1 ELSE 0 END AS FLOAT)) AS vector FROM embeddings"


def _centred(v: Views) -> DataFrame:
    """Vectors around the directions of their labels."""
    near = lambda x, i: (0.3 * x.cast("double") + F.when(i % 10 == F.col("label"), 1.0).otherwise(0.0)).cast("float")
    return v.table("embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", near).alias("vector"))


@query(
    "clustered_search",
    f"""WITH c AS MATERIALIZED ({_CENTRED}) SELECT c.id, round(list_cosine_similarity(c.vector::DOUBLE[], q.vector::DOUBLE[]), 6) AS score, true AS under_half FROM c, (SELECT vector FROM c WHERE id = {_SEED}) q
    ORDER BY list_cosine_similarity(c.vector::DOUBLE[], q.vector::DOUBLE[]) DESC, c.id LIMIT 20""",
)
def _(v):
    """Of vectors in clusters, an exact search reads under half."""
    rows, searched = _centred(v), pivots.Searched()
    index = pivots.PivotIndex.build(rows, fresh_path(v.spark, "pivots"), ident="id", cell_rows=64)
    one = rows.where(F.col("id") == _SEED).first()["vector"]
    hits = index.top_k([float(x) for x in one], 20, "id", searched=searched)
    return hits.select("id", F.round("score", 6).alias("score"), F.lit(2 * searched.scored < searched.rows).alias("under_half"))


@query("clustered_pairs", f"WITH c AS MATERIALIZED ({_CENTRED}) SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.id < b.id WHERE list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]) >= 0.99")
def _(v):
    return clusters.similar_pairs(_centred(v), 0.99, cell_rows=64).select("a", "b")


@query("face_class_members", "SELECT f.id, c.first FROM faces f JOIN (SELECT vector, min(id) AS first FROM faces GROUP BY vector) c ON c.vector = f.vector")
def _(v):
    return pivots.members(v.faces).select("id", "first")


@query(
    "best_person",
    """SELECT id, person_id, round(score, 6) AS score FROM (
        SELECT n.id, f.person_id, list_cosine_similarity(n.vector::DOUBLE[], f.vector::DOUBLE[]) AS score,
               row_number() OVER (PARTITION BY n.id ORDER BY list_cosine_similarity(n.vector::DOUBLE[], f.vector::DOUBLE[]) DESC, f.id) AS rn
        FROM faces n JOIN faces f ON f.person_id IS NOT NULL WHERE n.person_id IS NULL) WHERE rn = 1 AND score >= 0.42""",
)
def _(v):
    new = v.faces.where("person_id is null")
    return people.best_person(new, people.named_faces(v.faces)).withColumn("score", F.round("score", 6))


@query("propagate_person", f"SELECT f.id, round(list_cosine_similarity(vector::DOUBLE[], q), 6) AS score FROM faces f, {_Q} WHERE person_id IS NULL AND media_item_id <> 3 AND list_cosine_similarity(vector::DOUBLE[], q) >= 0.2")
def _(v):
    return people.propagate(v.faces, _seed(v), own_media=3, threshold=0.2).select("id", F.round("score", 6).alias("score"))


_EDGES = "SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]) AS score FROM (SELECT min(id) AS id, vector FROM faces GROUP BY vector) a JOIN (SELECT min(id) AS id, vector FROM faces GROUP BY vector) b ON a.id < b.id WHERE list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]) >= 0.42"


@query("face_pairs", f"SELECT a, b, round(score, 6) AS score FROM ({_EDGES})")
def _(v):
    return clusters.similar_pairs(v.faces).select("a", "b", F.round("score", 6).alias("score"))


@query(
    "face_links",
    """WITH c AS MATERIALIZED (SELECT min(id) AS first, count(*) AS times, vector FROM faces GROUP BY vector),
        n AS (SELECT a.first, sum(b.times) AS n FROM c a JOIN c b ON a.first <> b.first WHERE list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]) >= 0.42 GROUP BY a.first)
    SELECT f.id, c.first AS class_id, CAST(c.times - 1 + coalesce(n.n, 0) AS BIGINT) AS n_links FROM faces f JOIN c ON c.vector = f.vector LEFT JOIN n ON n.first = c.first""",
)
def _(v):
    """What ``face_pairs`` says of each face, without the pairs."""
    return clusters.links(v.faces)


ORACLE_SQL["face_clusters"] = with_views("SELECT * FROM faces").removesuffix("SELECT * FROM faces").rstrip() + f""", e AS MATERIALIZED ({_EDGES}),
    s AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT f.id, c.first FROM faces f JOIN (SELECT vector, min(id) AS first FROM faces GROUP BY vector) c USING (vector)
        UNION SELECT c.first, f.id FROM faces f JOIN (SELECT vector, min(id) AS first FROM faces GROUP BY vector) c USING (vector)), r(id, reached) AS (SELECT id, id FROM faces UNION SELECT r.id, s.b FROM r JOIN s ON s.a = r.reached),
    c AS (SELECT id, min(reached) AS component FROM r GROUP BY id)
    SELECT id, component, dense_rank() OVER (ORDER BY component) - 1 AS cluster_id FROM c"""
QUERIES["face_clusters"] = lambda spark, d: clusters.clusters(Views(spark, d).faces)


@query("l2_normalized", "SELECT id, round(sqrt(list_sum(list_transform(vector::DOUBLE[], lambda x: x * x))), 3) AS norm FROM vectors")
def _(v):
    return v.vectors.select("id", F.round(vectors.norm(vectors.l2_normalize(F.col("vector"))), 3).alias("norm"))


_FILES = "SELECT id, path, size_bytes, captured_at, modified_at, created_at, width, height, sha256(content) AS sha256 FROM media WHERE media_type = 'image' AND NOT missing"
_KEEP = f"PARTITION BY sha256 ORDER BY coalesce({_DATE}, 9223372036854775807), coalesce(width * height, 0) DESC, coalesce(size_bytes, 0) DESC, path"


def _files(v: Views) -> DataFrame:
    return v.media.where("media_type = 'image' and not missing").withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))


@query("exact_duplicates", f"SELECT sha256, n, path AS keep_path, CAST(group_bytes AS BIGINT) AS group_bytes FROM (SELECT *, count(*) OVER (PARTITION BY sha256) AS n, sum(coalesce(size_bytes, 0)) OVER (PARTITION BY sha256) AS group_bytes, row_number() OVER ({_KEEP}) AS rn FROM ({_FILES})) WHERE rn = 1 AND n > 1")
def _(v):
    return duplicates.exact_groups(_files(v)).select("sha256", "n", "keep_path", "group_bytes")


@query("duplicate_members", f"SELECT sha256, id, path, rn = 1 AS is_keeper FROM (SELECT *, count(*) OVER (PARTITION BY sha256) AS n, row_number() OVER ({_KEEP}) AS rn FROM ({_FILES})) WHERE n > 1")
def _(v):
    return duplicates.exact_members(_files(v)).select("sha256", "id", "path", "is_keeper")


@query("duplicate_group_ids", f"SELECT 'exact-' || row_number() OVER (ORDER BY path) AS group_id, path AS keep_path FROM (SELECT *, count(*) OVER (PARTITION BY sha256) AS n, row_number() OVER ({_KEEP}) AS rn FROM ({_FILES})) WHERE rn = 1 AND n > 1")
def _(v):
    return duplicates.numbered(duplicates.exact_groups(_files(v)), "exact").select("group_id", "keep_path")


@query("cleanup_totals", f"SELECT count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS duplicate_files, CAST(sum(b - coalesce(size_bytes, 0)) AS BIGINT) AS duplicate_bytes FROM (SELECT *, count(*) OVER (PARTITION BY sha256) AS n, sum(coalesce(size_bytes, 0)) OVER (PARTITION BY sha256) AS b, row_number() OVER ({_KEEP}) AS rn FROM ({_FILES})) WHERE rn = 1 AND n > 1")
def _(v):
    members = duplicates.exact_members(_files(v))
    return members.agg(
        F.count_if("is_keeper").alias("groups"), F.count_if(~F.col("is_keeper")).cast("bigint").alias("duplicate_files"),
        F.coalesce(F.sum(F.when(~F.col("is_keeper"), F.coalesce("size_bytes", F.lit(0)))), F.lit(0)).alias("duplicate_bytes"),
    )


_HAM = lambda c: f"bit_count(xor(('0x' || a.{c})::UBIGINT, ('0x' || b.{c})::UBIGINT))"


_CLASSES = "SELECT ahash, phash, dhash, min(path) AS path, count(*) AS files FROM prints GROUP BY ahash, phash, dhash"


@query("visual_pairs", f"SELECT a.path AS path_a, b.path AS path_b, CAST({_HAM('phash')} + {_HAM('dhash')} AS INTEGER) AS score FROM ({_CLASSES}) a JOIN ({_CLASSES}) b ON a.ahash = b.ahash AND a.path < b.path WHERE {_HAM('phash')} <= 6 AND {_HAM('dhash')} <= 8")
def _(v):
    return duplicates.visual_pairs(v.prints)


_BITS = lambda a, b: f"bit_count(xor({a}, {b}))"
_TAKES = f"list_filter(g.anchors, lambda x: {_BITS('x.p', 'c.p')} <= 6 AND {_BITS('x.d', 'c.d')} <= 8)"


@query("visual_class_members", "SELECT p.path, c.path AS first FROM prints p JOIN (SELECT ahash, phash, dhash, min(path) AS path FROM prints GROUP BY ahash, phash, dhash) c ON c.ahash = p.ahash AND c.phash = p.phash AND c.dhash = p.dhash")
def _(v):
    classes = duplicates.print_classes(v.prints).select("ahash", "p", "d", "first")
    value = lambda c: F.conv(c, 16, -10).cast("bigint")
    return v.prints.select("path", "ahash", value("phash").alias("p"), value("dhash").alias("d")).join(classes, ["ahash", "p", "d"]).select("path", "first")


# the anchor rule, a class after the other in order of path, with the anchors so far in a list
@query(
    "visual_groups",
    f"""WITH c AS MATERIALIZED (SELECT ahash, path, files, p, d, row_number() OVER (PARTITION BY ahash ORDER BY path) AS rn FROM (SELECT ahash, ('0x' || phash)::UBIGINT AS p, ('0x' || dhash)::UBIGINT AS d, path, files FROM ({_CLASSES}))),
    g AS (SELECT ahash, rn, [{{'path': path, 'p': p, 'd': d}}] AS anchors, path AS anchor, path, 0 AS score, files FROM c WHERE rn = 1
        UNION ALL SELECT c.ahash, c.rn, CASE WHEN len({_TAKES}) = 0 THEN list_append(g.anchors, {{'path': c.path, 'p': c.p, 'd': c.d}}) ELSE g.anchors END,
            CASE WHEN len({_TAKES}) = 0 THEN c.path ELSE {_TAKES}[1].path END, c.path, CASE WHEN len({_TAKES}) = 0 THEN 0 ELSE {_BITS(_TAKES + '[1].p', 'c.p')} + {_BITS(_TAKES + '[1].d', 'c.d')} END, c.files
        FROM g JOIN c ON c.ahash = g.ahash AND c.rn = g.rn + 1),
    s AS (SELECT ahash, anchor, max(score) AS score FROM g GROUP BY ahash, anchor HAVING sum(files) > 1),
    q AS (SELECT g.path, g.anchor, s.score, c.ahash, c.p, c.d FROM g JOIN s ON s.ahash = g.ahash AND s.anchor = g.anchor JOIN c ON c.ahash = g.ahash AND c.path = g.path)
    SELECT f.path, q.anchor, CAST(q.score AS INTEGER) AS score FROM prints f JOIN q ON q.ahash = f.ahash AND q.p = ('0x' || f.phash)::UBIGINT AND q.d = ('0x' || f.dhash)::UBIGINT""",
)
def _(v):
    return duplicates.visual_members(v.prints)


@query("hamming_distances", f"SELECT a.path AS path_a, b.path AS path_b, CAST({_HAM('phash')} AS INTEGER) AS bits FROM prints a JOIN prints b ON a.path = '/p/1'")
def _(v):
    one = v.prints.where("path = '/p/1'").select("phash").first()["phash"]
    return v.prints.select(F.lit("/p/1").alias("path_a"), F.col("path").alias("path_b"), vectors.hamming(F.lit(one), F.col("phash")).alias("bits"))


@query(
    "needs_processing",
    f"SELECT m.id FROM media m WHERE {_LISTED} AND NOT missing AND NOT EXISTS (SELECT 1 FROM processing c WHERE c.media_item_id = m.id AND c.processor = 'embeddings' AND c.model = 'clip' AND c.size_bytes IS NOT DISTINCT FROM m.size_bytes AND c.modified_at IS NOT DISTINCT FROM m.modified_at)",
)
def _(v):
    return incremental.needs_processing(filters.processing_scope(v.media), v.processing, "embeddings", "clip").select("id")


_SAME = "m.size_bytes IS NOT DISTINCT FROM l.size_bytes AND m.modified_at IS NOT DISTINCT FROM l.modified_at"
_DIFF = f"SELECT l.path, l.size_bytes, CASE WHEN m.id IS NULL THEN 'new' WHEN {_SAME} THEN 'unchanged' ELSE 'changed' END AS action FROM listing l LEFT JOIN (SELECT * FROM media WHERE NOT missing) m ON m.path = l.path"


@query("scan_diff", _DIFF)
def _(v):
    return incremental.scan_diff(v.listing, v.media).select("path", "size_bytes", "action")


@query("scan_summary", f"SELECT count(*) AS scanned, count(*) FILTER (action <> 'unchanged') AS imported, count(*) FILTER (action = 'unchanged') AS skipped, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS errors FROM ({_DIFF})")
def _(v):
    return incremental.scan_summary(incremental.scan_diff(v.listing, v.media))


@query(
    "media_upsert",
    f"""SELECT coalesce(m.id, (SELECT max(id) FROM media) + row_number() OVER (PARTITION BY m.id IS NULL ORDER BY d.path)) AS id, d.path, d.size_bytes, false AS missing,
        CAST(coalesce(m.imported_at, 1800000000) AS BIGINT) AS imported_at FROM ({_DIFF}) d LEFT JOIN (SELECT *, 1500000000 AS imported_at FROM media) m ON m.path = d.path WHERE d.action <> 'unchanged'
        UNION ALL SELECT m.id, m.path, m.size_bytes, m.missing, CAST(1500000000 AS BIGINT) AS imported_at FROM media m WHERE m.path NOT IN (SELECT path FROM ({_DIFF}) WHERE action <> 'unchanged')""",
)
def _(v):
    media = v.media.withColumn("imported_at", F.lit(1500000000).cast("bigint")).drop("content")
    changed = incremental.scan_diff(v.listing, media).where("action <> 'unchanged'")
    return incremental.upsert_media(media, changed).select("id", "path", "size_bytes", "missing", "imported_at")


@query("mark_missing", "SELECT id, missing OR NOT EXISTS (SELECT 1 FROM listing l WHERE l.path = m.path) AS missing FROM media m")
def _(v):
    return incremental.mark_missing(v.media, v.listing).select("id", "missing")


@query(
    "cache_profile",
    "SELECT count(*) AS total_entries, count(sha256) AS exact_hash_entries, count(ahash) AS visual_fingerprint_entries, count(*) FILTER (sha256 IS NOT NULL AND ahash IS NOT NULL) AS complete_entries, CAST(sum(length(path) + coalesce(length(sha256), 0) + coalesce(length(ahash), 0) + coalesce(length(dhash), 0) + coalesce(length(phash), 0) + 64) AS BIGINT) AS cache_bytes_estimate, min(updated_at) AS oldest_updated_at, max(updated_at) AS newest_updated_at FROM cleanup",
)
def _(v):
    return incremental.cache_profile(v.cleanup)


@query(
    "selection_profile",
    f"""SELECT count(*) AS selected_images, count(c.sha256) FILTER (f) AS selected_exact_cached, count(c.ahash) FILTER (f) AS selected_visual_cached, count(*) FILTER (f AND c.sha256 IS NOT NULL AND c.ahash IS NOT NULL) AS selected_complete_cached,
        count(*) - count(c.sha256) FILTER (f) AS selected_uncached_exact, count(*) - count(c.ahash) FILTER (f) AS selected_uncached_visual, count(c.path) FILTER (NOT f) AS stale_selected_entries
        FROM (SELECT s.path, x.path AS p, x.sha256, x.ahash, s.size_bytes IS NOT DISTINCT FROM x.size_bytes AND s.modified_at IS NOT DISTINCT FROM x.modified_at AS f FROM (SELECT * FROM media WHERE {_LISTED} AND NOT missing AND media_type = 'image') s LEFT JOIN cleanup x ON x.path = s.path) t, LATERAL (SELECT t.p AS path, t.sha256, t.ahash) c""",
)
def _(v):
    return incremental.selection_profile(v.cleanup, filters.cleanup_scope(v.media).select("path", "size_bytes", "modified_at"))


@query("month_groups", f"SELECT CASE WHEN ts IS NULL OR ts = 0 THEN 'unknown' ELSE strftime(make_timestamp(ts * 1000000), '%Y-%m') END AS month, count(*) AS items FROM (SELECT CAST({_DATE} AS BIGINT) AS ts FROM media) GROUP BY month")
def _(v):
    return v.media.groupBy(dates.month_key(dates.sort_ts()).alias("month")).agg(F.count("*").alias("items"))


@query("catalog_counts", "SELECT count(*) AS total, count(*) FILTER (media_type = 'image') AS images, count(*) FILTER (media_type = 'video') AS videos, count(*) FILTER (missing) AS missing FROM media")
def _(v):
    return v.media.agg(F.count("*").alias("total"), F.count_if(F.col("media_type") == "image").alias("images"), F.count_if(F.col("media_type") == "video").alias("videos"), F.count_if("missing").alias("missing"))


@query("selected_paths", "SELECT count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM (SELECT path, size_bytes FROM media WHERE media_type = 'video' UNION SELECT path, size_bytes FROM media WHERE missing)")
def _(v):
    """What two selections hold together."""
    rows = v.media.where("media_type = 'video'").unionAll(v.media.where("missing")).select("path", "size_bytes").distinct()
    return rows.agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
