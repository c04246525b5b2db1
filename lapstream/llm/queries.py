"""Queries of the corpus operators over the driver tables, with SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapstream.llm import bpe, exact, imatch, langid, lines, mixing, packing, phrases, secrets, simhash, toxicity, trie, warc
from lapstream.llm.common import read_table
from lapstream.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


@query(
    "op1_exact_dedup",
    """
    WITH d AS (
        SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
        FROM documents
    )
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
    FROM d
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.find_copies(read_table(spark, sf_dir, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


@query(
    "op4_line_dedup",
    """
    WITH boilerplate AS (
        SELECT coalesce(list(line), []) AS gone
        FROM (
            SELECT trim(line, ' ') AS line
            FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
            WHERE trim(line, ' ') <> ''
            GROUP BY 1
            HAVING count(DISTINCT source) >= 5
        )
    ), d AS (
        SELECT doc_id, text, string_split(text, chr(10)) AS every,
               list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(gone, trim(x, ' '))) AS kept
        FROM documents, boilerplate
    )
    SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(kept, chr(10)), '') END AS text,
           coalesce(len(every), 0) AS n_lines, coalesce(len(every) - len(kept), 0) AS n_removed
    FROM d
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read_table(spark, sf_dir, "documents"), site="source", min_sites=5)


@query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    base = F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", base, "spans")


@query("op8_imatch")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = imatch.fingerprints(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        imatch.as_text(F.col("hashes")).alias("fingerprint"),
        imatch.as_text(F.col("edited_hashes")).alias("edited_fingerprint"),
        imatch.likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        imatch.likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )


@query("op9_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return digests(coded)


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def damaged_copy(found: DataFrame) -> DataFrame:
    """A second replica of which one record in fifty or so has a byte changed."""
    chosen = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 2) < "05"
    rotten = F.overlay("record", F.lit("#"), F.lit(6), F.lit(1))
    return found.withColumn("record", F.when(chosen, rotten).otherwise(F.col("record")))


@query(
    "op10_warc_audit",
    """
    WITH r AS (
        SELECT page_id, coalesce(CAST(page_id AS VARCHAR), '') AS id,
               concat('WARC/1.0', e, 'WARC-Type: resource', e, 'WARC-Record-ID: <urn:page:', page_id, '>', e,
                      'WARC-Date: 1970-01-01T00:00:00Z', e, 'WARC-Target-URI: ', url, e,
                      'Content-Type: text/html', e, 'Content-Length: ', strlen(coalesce(html, '')), e, e,
                      html, e, e) AS record
        FROM pages, (SELECT chr(13) || chr(10) AS e)
    ), f AS (
        SELECT page_id, md5(id) AS m, sha256(record) AS digest, strlen(record) AS length,
               CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) % ceil((SELECT count(*) FROM r) / 1024)::BIGINT AS file
        FROM r
    )
    SELECT page_id, file, sum(length) OVER w - length AS start, length, digest,
           CASE WHEN substr(m, 1, 2) < '05' THEN 'corrupt' ELSE 'intact' END AS status
    FROM f WINDOW w AS (PARTITION BY file ORDER BY page_id NULLS LAST, digest ROWS UNBOUNDED PRECEDING)
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.records(read_table(spark, sf_dir, "pages"))
    files = warc.file_count(found)
    replicas = [cut_lineage(warc.layout(r, files), "warc-layout") for r in (found, damaged_copy(found))]
    return warc.audit(*replicas)


@query(
    "op13_prefix_trie",
    r"""
    WITH t AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               sha256(concat(length(coalesce(role, '')), ':', role, text)) AS said, turn
        FROM conversations WHERE conv_id IS NOT NULL
    ), o AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) AS p FROM t
    ), c AS (
        SELECT conv_id, conv_id - conv_id % 20 AS base, CAST(conv_id AS VARCHAR) AS s FROM o GROUP BY conv_id
    ), h AS (
        -- Unsigned crc32 of the decimal id, bit by bit: x counts the bits, a is the remainder so far.
        SELECT conv_id, base, xor(4294967295, list_reduce(
            list_concat([4294967295], range(8 * length(s))),
            lambda a, x: xor(
                xor(a, CASE WHEN x % 8 = 0 THEN ascii(s[x // 8 + 1]) ELSE 0 END) >> 1,
                (xor(a, CASE WHEN x % 8 = 0 THEN ascii(s[x // 8 + 1]) ELSE 0 END) & 1) * 3988292384)
        )) % 4 AS h
        FROM c
    ), u AS (
        SELECT h.conv_id, 0 AS part, o.p, o.said, o.text FROM h JOIN o ON o.conv_id = h.base AND o.p <= h.h
        UNION ALL
        SELECT h.conv_id, 1, o.p, o.said, o.text FROM h JOIN o ON o.conv_id = h.conv_id AND o.p > h.h
    ), r AS (
        SELECT conv_id, list(said ORDER BY part, p) AS path,
               list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY part, p) AS words
        FROM u GROUP BY conv_id
    ), w AS (
        SELECT conv_id, coalesce(path, []) AS path, words FROM h LEFT JOIN r USING (conv_id)
    ), m AS (
        SELECT conv_id, d, path[1:d] AS node, CASE WHEN d > 0 THEN path[1:d - 1] END AS parent,
               CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words, len(path) = d AS ends
        FROM w, unnest(range(len(path) + 1)) AS x(d)
    ), n AS (
        SELECT node, max(d) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
               max(words) AS words,
               coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ids
        FROM m GROUP BY node
    ), k AS (
        SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent
    ), b AS (
        SELECT n.node[1:d] AS node, count(*) FILTER (n_children IS NULL) AS n_leaves,
               CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens
        FROM n LEFT JOIN k ON k.node = n.node, unnest(range(depth + 1)) AS x(d) GROUP BY 1
    )
    SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
           n_leaves, saved_tokens, sha256(n.ids) AS ends_sha256
    FROM n JOIN b ON b.node = n.node LEFT JOIN k ON k.node = n.node LEFT JOIN n AS a ON a.node = n.parent
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


@query("op11_best_fit_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query(
    "op12_collocations",
    r"""
    WITH p AS (
        SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
        FROM (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        )
    ), one AS (
        SELECT lang, u AS phrase, count(*) AS f FROM (SELECT lang, unnest(w) AS u FROM p) GROUP BY ALL
    ), total AS (
        SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang
    ), two AS (
        SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS f
        FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM p) GROUP BY ALL HAVING count(*) >= 10
    ), three AS (
        SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS f
        FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM p) GROUP BY ALL HAVING count(*) >= 10
    ), inside AS (
        SELECT lang, w1, w2, max(f) AS f
        FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL
    ), cut AS (
        SELECT two.lang, two.w1 || ' ' || two.w2 AS phrase, two.f AS a, 1 AS k, x.f AS l, y.f AS r
        FROM two JOIN one AS x ON x.lang = two.lang AND x.phrase = two.w1
        JOIN one AS y ON y.lang = two.lang AND y.phrase = two.w2
        LEFT JOIN inside AS i ON i.lang = two.lang AND i.w1 = two.w1 AND i.w2 = two.w2
        WHERE i.f IS NULL OR 100 * i.f < 50 * two.f
        UNION ALL
        SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, x.f, y.f
        FROM three AS t JOIN one AS x ON x.lang = t.lang AND x.phrase = t.w1
        JOIN two AS y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
        UNION ALL
        SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f
        FROM three AS t JOIN two AS x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2
        JOIN one AS y ON y.lang = t.lang AND y.phrase = t.w3
    ), scored AS (
        SELECT *, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cut
    ), lowest AS (
        SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
        FROM lowest WHERE nth = 1
    )
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))
