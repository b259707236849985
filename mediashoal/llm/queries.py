"""The queries of this subpackage, one or more for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediashoal.llm import bpe, chat, codes, lines, media, mixing, pii, quality, repair, shards, simhash, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat.format_turns(chat.turns_of(_table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias(c)
    return made.select("pair_id", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"), F.col("n_common").cast("bigint").alias("n_common"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_all(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans", "n_added")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write(_table(spark, sf_dir, "pages"))
    return warc.read(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def media_digests(docs: DataFrame) -> DataFrame:
    read = media.decode(media.encode(docs))
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -media.UNIT, media.UNIT)).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("times").cast("string"), F.sha2(F.to_json(F.struct("times", "pairs")), 256)).alias("feature"),
    )


def op9_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(_table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


#: Shards before and after.
OLD_SHARDS, NEW_SHARDS = 32, 40


def sharded_digests(docs: DataFrame) -> DataFrame:
    """Documents in 32 shards by key, moved into 40 of equal bytes, and read back."""
    moved, _ = shards.reshard(shards.lay_out(docs, OLD_SHARDS, later=NEW_SHARDS), [1] * NEW_SHARDS)
    text = F.coalesce("row.text", F.lit(""))
    return moved.read().select(
        "row.doc_id", "size", F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded_digests(_table(spark, sf_dir, "documents"))


def vector_codes(embeddings: DataFrame) -> DataFrame:
    trained = codes.train(embeddings)
    digest = trained.books.digest() if trained.books else None
    return codes.with_label_error(codes.encode(trained)).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def repaired_digests(conversations: DataFrame) -> DataFrame:
    made = repair.repair(repair.damage(conversations), copies="copies")
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    return made.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_digests(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_preferences": op1_preferences,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_pii": op5_pii,
    "op6_warc": op6_warc,
    "op7_url_filter": op7_url_filter,
    "op8_line_dedup": op8_line_dedup,
    "op9_wav_fingerprints": op9_wav_fingerprints,
    "op10_mix_sources": op10_mix_sources,
    "op11_reshard": op11_reshard,
    "op12_vector_codes": op12_vector_codes,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_preferences": """
        WITH c AS (SELECT DISTINCT conv_id AS pair_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
                   FROM conversations WHERE conv_id IS NOT NULL),
        e AS (SELECT pair_id, max(turn) AS last, arg_max(text, turn) AS reply FROM c GROUP BY pair_id),
        r AS (SELECT c.pair_id, turn, role, CASE WHEN turn = e.last THEN coalesce(o.reply, c.text) ELSE c.text END AS text
              FROM c JOIN e USING (pair_id) LEFT JOIN e AS o ON o.pair_id = xor(c.pair_id, 1)),
        j AS (SELECT c.pair_id, c.turn, c.role, c.text AS a, r.text AS b FROM c JOIN r USING (pair_id, turn)),
        f AS (SELECT j.*, d.first FROM j LEFT JOIN (SELECT pair_id, min(turn) AS first FROM j WHERE a <> b GROUP BY pair_id) d USING (pair_id)),
        s AS (SELECT pair_id, turn, role, coalesce(turn >= first, false) AS diff, '<|' || replace(role, '<|', '< |') || '|>' || chr(10) AS head,
                     replace(a, '<|', '< |') || '<|end|>' || chr(10) AS ta, replace(b, '<|', '< |') || '<|end|>' || chr(10) AS tb FROM f),
        o AS (SELECT *, coalesce(sum(length(head || ta)) FILTER (diff) OVER w, 0) + length(head) AS sa,
                     coalesce(sum(length(head || tb)) FILTER (diff) OVER w, 0) + length(head) AS sb
              FROM s WINDOW w AS (PARTITION BY pair_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT pair_id, coalesce(string_agg(head || ta, '' ORDER BY turn) FILTER (NOT diff), '') AS prompt,
               coalesce(string_agg(head || ta, '' ORDER BY turn) FILTER (diff), '') AS chosen,
               coalesce(string_agg(head || tb, '' ORDER BY turn) FILTER (diff), '') AS rejected,
               coalesce(string_agg(sa || ':' || (sa + length(ta) - 1), ',' ORDER BY turn) FILTER (diff AND role = 'assistant'), '') AS chosen_mask,
               coalesce(string_agg(sb || ':' || (sb + length(tb) - 1), ',' ORDER BY turn) FILTER (diff AND role = 'assistant'), '') AS rejected_mask,
               count(*) FILTER (NOT diff) AS n_common
        FROM o GROUP BY pair_id""",
    "op6_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest, sha256(b) AS digest FROM p),
        t AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS owner FROM h)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to
        FROM t""",
    "op8_line_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        j AS (SELECT r, doc_id, line, pos, coalesce(doc_id <> last, false) AS gone FROM k LEFT JOIN c USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM j GROUP BY r, doc_id""",
}


def _repair_sql() -> str:
    """From each conversation's last row to its first, for each of four states (before
    everything, after a turn of the system, user, assistant) the least of texts of a cost
    (12 digits), an audit, chr(1) and the repaired lines, each after a line feed."""
    add = lambda c, letter, line, x: (
        f"lpad((left({x}, 12)::BIGINT + {c})::VARCHAR, 12, '0') || '{letter}' || substr({x}, 13, strpos({x}, chr(1)) - 12) || {line} || substr({x}, strpos({x}, chr(1)) + 1)"
    )
    nexts, asked = (3, 3, 4, 3), ("user", "user", "assistant", "user")
    rows = []
    for q, (to, role) in enumerate(zip(nexts, asked, strict=True), 1):
        cut, own = "CASE fault WHEN 'truncated' THEN 3 ELSE 0 END", "chr(10) || role || ':' || text"
        keep = f"CASE WHEN fault IN ('blank', 'duplicate') THEN NULL WHEN ini = '{role[0]}' THEN {add(cut, 'K', own, f'v[{to}]')}"
        keep += f" WHEN ini = 's' THEN {add(cut, 'K', own, 'v[2]')} END" if q == 1 else " END"
        rerole = f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {add(f'3 + {cut}', 'R', f"chr(10) || '{role}:' || text", f'v[{to}]')} END"
        rows.append(f"least({add(4, 'D', "''", f'v[{q}]')}, {keep}, {rerole})")
    user, assistant = (f"least(v[{q}], {add(3, 'I', f"chr(10) || '{asked[q - 1]}:'", f'v[{nexts[q - 1]}]')})" for q in (3, 4))
    first, system = (f"least(v[{q}], {add(3, 'I', "chr(10) || 'user:'", 'u')})" for q in (1, 2))
    done = "'000000000000' || chr(1)"
    bit = "xor(xor(c, CASE WHEN j % 8 = 0 THEN ascii(substr(t, j // 8 + 1, 1)) ELSE 0 END) >> 1, CASE WHEN xor(c, CASE WHEN j % 8 = 0 THEN ascii(substr(t, j // 8 + 1, 1)) ELSE 0 END) & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"""
        WITH RECURSIVE b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS t FROM conversations),
        c AS (SELECT *, xor(list_reduce(range(8 * length(t)), lambda c, j: {bit}, 4294967295::BIGINT), 4294967295) % 20 AS k FROM b),
        d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
                     CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
        f AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS ini,
                     row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
                     row_number() OVER w AS i, lag(left(role, 1)) OVER w || left(role, 1) AS pair
              FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
        g AS MATERIALIZED (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM f),
        n AS MATERIALIZED (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n_rows, count(*) FILTER (fault = 'blank') AS blank,
                     count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
              FROM g GROUP BY conv_id),
        r(conv_id, i, v) AS (
            SELECT conv_id, n_rows, [{done}, '000000000006II' || chr(1) || chr(10) || 'user:' || chr(10) || 'assistant:', '000000000003I' || chr(1) || chr(10) || 'assistant:', {done}] FROM n
            UNION ALL SELECT conv_id, i, [{first}, {system}, u, {assistant}] FROM (SELECT *, {user} AS u FROM (
                SELECT r.conv_id, r.i - 1 AS i, [{", ".join(rows)}] AS v FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.i = r.i))),
        o AS (SELECT conv_id, v[1] AS x, strpos(v[1], chr(1)) AS pos FROM r WHERE i = 0)
        SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(left(x, 12)::BIGINT, 0) AS cost, coalesce(substr(x, 13, pos - 13), '') AS audit,
               sha256(coalesce(substr(x, pos + 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM a.conv_id"""


ORACLE_SQL["op13_conversation_repair"] = _repair_sql()


def _codes_sql(rounds: int = 6) -> str:
    """Each round as two tables: the nearest entry of every part, and the entries moved."""
    far = lambda k: f"SELECT rid, p.p, e, list_sum(list_transform(list_zip(p.x, b{k}.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS far FROM p JOIN b{k} ON b{k}.p = p.p"
    steps = ""
    for k in range(rounds + 1):
        steps += f""",
        a{k} AS MATERIALIZED (SELECT rid, p, e, far FROM ({far(k)}) QUALIFY row_number() OVER (PARTITION BY rid, p ORDER BY far, e) = 1)"""
        if k < rounds:
            steps += f""",
        m{k} AS (SELECT p, e, list(m ORDER BY j) AS x FROM (SELECT p, e, j, floor(sum(c)::DOUBLE / count(*))::BIGINT AS m
                 FROM (SELECT a.p, a.e, unnest(p.x) AS c, unnest(range(len(p.x))) AS j FROM a{k} a JOIN p USING (rid, p)) GROUP BY p, e, j) GROUP BY p, e),
        b{k + 1} AS MATERIALIZED (SELECT b{k}.p, b{k}.e, coalesce(m{k}.x, b{k}.x) AS x FROM b{k} LEFT JOIN m{k} USING (p, e))"""
    return f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS ints
                 FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT rid, p, ints[p * (len(ints) // 8) + 1 : (p + 1) * (len(ints) // 8)] AS x FROM v, range(8) t(p)),
        b0 AS MATERIALIZED (SELECT p, e, x FROM (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, ints) - 1 AS e FROM v QUALIFY e < 16) JOIN p USING (rid)){steps},
        c AS (SELECT string_agg(array_to_string(x, ','), ',' ORDER BY p, e) AS text FROM b{rounds}),
        r AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY rid)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha256(text) AS codebooks_sha256 FROM v JOIN r USING (rid), c"""


ORACLE_SQL["op12_vector_codes"] = _codes_sql()


def oracle_sql() -> dict[str, str]:
    """With the SQL that holds fitted weights, which takes a second to make."""
    return ORACLE_SQL | {"op7_url_filter": urls.oracle(urls.fitted())}
