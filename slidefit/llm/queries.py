"""The operators' queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, compression_quality, flac, near_dedup, packing, quality_rules, sharding, spbpe, suffix_dedup, url_filters

SHARDS = [f"shard-{k:03d}" for k in range(96)]
SLOTS = 65537


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near-duplicates."""
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sharding.place(docs, SHARDS, SLOTS).select("doc_id", "n_bytes", "slot", "shard")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 50-byte strings that start in a smaller one."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    trap = "\\### Assistant: </turn> ok"
    own = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_conversations(own.unionByName(more), public_tokenizers.path("byte_bpe_50k.json")))
    return back.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a FLAC stream, decoded and described."""
    return flac.described(flac.to_media(table(spark, sf_dir, "documents")))


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; a third of the ids is held out from learning."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = compression_quality.fit(docs, labels, third != 1)
    scored = compression_quality.score(docs, model)
    return scored.select("doc_id", (third == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "difference")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged against the list entries that hold when it was fetched.

    The tables have no lists: page p counts as fetched p minutes into 2024; each host that a page has, without its first
    label if it has four, gives entries at times drawn from its digest: an add, for two thirds a removal, for a third
    another add; one host in three is listed at all.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", (F.lit(1704067200) + F.col("page_id") * 60).cast("long").alias("fetched_at"))
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("h")).distinct()
    labels = F.split("h", r"\.")
    hosts = hosts.select(F.when(F.size(labels) >= 4, F.array_join(F.slice(labels, 2, 9), ".")).otherwise(F.col("h")).alias("host")).where("host <> ''").distinct()
    draw = lambda k, n: F.pmod(F.conv(F.substring(F.md5(F.concat(F.col("host"), F.lit(f":{k}"))), 1, 12), 16, 10).cast("long"), F.lit(n))
    first = F.lit(1704067200) + draw(1, 2_000_000)
    second, third = first + 60 + draw(2, 500_000), first + 60 + draw(2, 500_000) + 60 + draw(3, 500_000)
    listed = hosts.where(draw(0, 3) == 0)
    events = listed.select(
        F.lit("blocked hosts").alias("list"),
        "host",
        F.explode(
            F.filter(
                F.array(
                    F.struct(first.alias("at"), F.lit("add").alias("action")),
                    F.when(draw(4, 3) > 0, F.struct(second.alias("at"), F.lit("remove").alias("action"))),
                    F.when(draw(4, 3) > 1, F.struct(third.alias("at"), F.lit("add").alias("action"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("e"),
    ).select("list", "host", "e.at", "e.action")
    return url_filters.judge(pages, events)


def op9_spbpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of ids and text."""
    return spbpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rules and verdict of every document."""
    judged = quality_rules.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "score")


def sharding_sql() -> str:
    names = ", ".join(str(k) for k in sharding.fill_table(SHARDS, SLOTS).tolist())
    return f"""
WITH filled AS (SELECT [{names}] AS t),
slots AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
                 coalesce((('0x' || substr(sha256(doc_id::VARCHAR), 1, 15))::BIGINT % {SLOTS})::INTEGER, 0) AS slot FROM documents)
SELECT doc_id, n_bytes, slot, 'shard-' || lpad(t[slot + 1]::VARCHAR, 3, '0') AS shard FROM slots, filled"""


URL_FILTERS_SQL = r"""
WITH p AS (SELECT page_id, 1704067200 + page_id * 60 AS fetched_at,
                  lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM pages),
h AS (SELECT DISTINCT CASE WHEN len(string_split(host, '.')) >= 4 THEN array_to_string(string_split(host, '.')[2:], '.') ELSE host END AS host FROM p WHERE host <> ''),
d AS (SELECT host, ('0x' || substr(md5(host || ':0'), 1, 12))::BIGINT % 3 AS d0,
             1704067200 + ('0x' || substr(md5(host || ':1'), 1, 12))::BIGINT % 2000000 AS first_at,
             60 + ('0x' || substr(md5(host || ':2'), 1, 12))::BIGINT % 500000 AS d2,
             60 + ('0x' || substr(md5(host || ':3'), 1, 12))::BIGINT % 500000 AS d3,
             ('0x' || substr(md5(host || ':4'), 1, 12))::BIGINT % 3 AS d4 FROM h WHERE host <> ''),
i AS (SELECT host AS entry, first_at AS valid_from, CASE WHEN d4 > 0 THEN first_at + d2 END AS valid_to FROM d WHERE d0 = 0
      UNION ALL SELECT host, first_at + d2 + d3, NULL FROM d WHERE d0 = 0 AND d4 > 1),
m AS (SELECT p.page_id, i.entry, i.valid_from, row_number() OVER (PARTITION BY p.page_id ORDER BY length(i.entry) DESC, i.valid_from DESC) AS rn, count(*) OVER (PARTITION BY p.page_id) AS n
      FROM p JOIN i ON (p.host = i.entry OR ends_with(p.host, '.' || i.entry)) AND contains(i.entry, '.')
       AND i.valid_from <= p.fetched_at AND (i.valid_to IS NULL OR p.fetched_at < i.valid_to))
SELECT p.page_id, p.host, p.fetched_at, coalesce(m.n, 0)::BIGINT AS n_matches, m.entry AS matched_host, m.valid_from AS listed_at, m.n IS NOT NULL AS blocked
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.rn = 1"""

SUFFIX_DEDUP_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, unnest(range(length(h) // 2)) AS p FROM d),
s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS byte, CASE WHEN 2 * p + 100 <= length(h) THEN md5(substr(h, 2 * p + 1, 100)) END AS key FROM b),
m AS (SELECT key, min(doc_id) AS least FROM s WHERE key IS NOT NULL GROUP BY key),
f AS (SELECT s.doc_id, s.p, s.byte, coalesce(m.least < s.doc_id, false) AS hit FROM s LEFT JOIN m ON s.key = m.key),
c AS (SELECT doc_id, p, byte, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM c),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(r.n_removed, 0)::BIGINT AS n_removed, coalesce(r.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(r.kept, ''))) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id"""

CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, k, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
e AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, length(replace(replace(replace(replace(role, '\', '\\'), '<turn>', '<\turn>'), '<says>', '<\says>'), '</turn>', '<\/turn>'))
              + length(replace(replace(replace(replace(text, '\', '\\'), '<turn>', '<\turn>'), '<says>', '<\says>'), '</turn>', '<\/turn>')) AS n FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n + length('<turn><says></turn>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id, alone"""

QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_packing, op3_sharding, op4_suffix_dedup, op5_chat, op6_flac, op7_compression_quality, op8_url_filters, op9_spbpe, op10_quality_rules)}
ORACLES = {"op4_suffix_dedup": SUFFIX_DEDUP_SQL, "op5_chat": CHAT_SQL, "op3_sharding": sharding_sql(), "op8_url_filters": URL_FILTERS_SQL}
