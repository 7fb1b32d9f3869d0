"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats
from .common import narrow, table
from .decomposition import decompose
from .exact_dedup import exact_dedup
from .filter_audit import filter_audit
from .language_id import identify
from .mixing import mix_plan
from .near_dedup import near_classes
from .packing import pack
from .pii import pseudonymise
from .sharding import shard_by_bytes
from .vector_search import search
from .warc_zip import round_trip
from .whitening import whiten


#: For tables that hold no real data; a run over others sets spark.corvane.pseudonym.secret, which Spark redacts in its logs by that name.
PUBLIC_KEY = "corvane pseudonyms"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "shards")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    out = pseudonymise(docs, key=spark.conf.get("spark.corvane.pseudonym.secret", PUBLIC_KEY))
    return out.select("doc_id", "text", F.to_json("pii").alias("pii"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept", "copy_of")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op11_power_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompose(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_warc": op2_warc,
    "op3_vector_search": op3_vector_search,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_near_dedup": op6_near_dedup,
    "op7_sharding": op7_sharding,
    "op8_language_id": op8_language_id,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_power_of_two": op11_power_of_two,
    "op12_whitening": op12_whitening,
    "op13_filter_audit": op13_filter_audit,
}

#: White space as Python's str.split knows it.
_WHITE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper, sha1(h) AS x FROM p)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 CAST((CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keeper THEN keeper END AS refers_to
        FROM k""",
    "op3_vector_search": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
          FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                 CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_near_dedup": rf"""
        WITH RECURSIVE d AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        c AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS copy_of FROM d),
        r AS (SELECT doc_id, list_filter(string_split_regex(lower(t), '{_WHITE}'), lambda w: w <> '') AS w FROM c WHERE doc_id = copy_of),
        g AS (SELECT DISTINCT doc_id, unnest(CASE
            WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM r),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n na ON x = na.doc_id JOIN n nb ON y = nb.doc_id WHERE 5 * k >= 4 * (na.n + nb.n - k)),
        e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        reach(x, y) AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
        m AS (SELECT x, min(least(x, y)) AS root FROM reach GROUP BY x)
        SELECT c.doc_id, coalesce(root, copy_of) AS class_id, c.doc_id = coalesce(root, copy_of) AS kept, copy_of
        FROM c LEFT JOIN m ON copy_of = x""",
    "op9_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
          FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op13_filter_audit": r"""
        WITH w AS (
          SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id AS id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        f AS (
          SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                 CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                 || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END
                 || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                 || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
          FROM w LEFT JOIN l ON doc_id = id),
        p AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
        x(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        o AS (
          SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
          WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
        s AS (SELECT filter_order, step, filter_order[step] AS c, filter_order[1:step - 1] AS before FROM o, range(1, 6) r(step)),
        m AS (
          SELECT part, filter_order, step, c, fails, n, good, toxic, contains(fails, c) AS hit,
                 length(translate(fails, before, '')) < length(fails) AS gone FROM p, s),
        g AS (
          SELECT part, filter_order, step, c,
                 sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
                 sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = c THEN n ELSE 0 END) AS unique_fails,
                 sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END) AS toxic_lost
          FROM m GROUP BY part, filter_order, step, c)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
               CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
               CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley
        FROM g""",
}
