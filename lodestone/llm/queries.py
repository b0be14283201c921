"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, html_extract, jaccard_join, pitman_yor, sharding, substring_dedup, toxicity, urls

#: (verdict, host, path) of the URL query (fixed values).
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Pages whose host has one of these labels are listed (fixed values).
LISTED_LABELS = ["spam-farm", "cheap-pills"]


def byte_vocabulary() -> str:
    """Path of the byte-level vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "url", "text", "n_chars")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.duplicate_spans(table(spark, sf_dir, "documents"), size=50)).withColumnRenamed("id", "doc_id")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), size=5, percent=80).withColumnRenamed("id", "doc_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages judged; listed are the canonical URLs of all pages on hosts with a label of LISTED_LABELS."""
    pages = table(spark, sf_dir, "pages")
    canon = urls.canonical(F.col("url"))
    listed = pages.select(canon.alias("canon")).where(F.arrays_overlap(F.split(F.split("canon", "/")[0], r"\."), F.array(*map(F.lit, LISTED_LABELS))))
    return urls.judge(pages, listed, URL_RULES).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(table(spark, sf_dir, "documents"), 40)
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Learnt from the labels outside fold 0 of 5; labels of documents that aren't in docs don't count."""
    return toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.in_fold(F.col("doc_id"), 5, 0)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = toxicity.score(docs, toxicity_model(spark, docs, sf_dir)).withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", toxicity.in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=13)
    return decontaminate.digest(found).withColumnRenamed("id", "doc_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), byte_vocabulary()).withColumnRenamed("id", "doc_id")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pitman_yor.score_corpus(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_url_filter": op4_url_filter,
    "op5_sharding": op5_sharding,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_bpe": op9_bpe,
    "op10_lm_scoring": op10_lm_scoring,
}

_HOST = "CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
_PATH = "CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END"
_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_ORDERED = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))

ORACLE_SQL: dict[str, str] = {
    "op4_url_filter": f"""
        WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
        c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/$', '') END AS canon FROM p),
        listed AS (SELECT DISTINCT canon FROM c WHERE list_has_any(string_split(string_split(canon, '/')[1], '.'), {LISTED_LABELS!r}))
        SELECT page_id, host, path,
          CASE {' '.join(f"WHEN {_FITS.format(h, p)} THEN '{h + p}'" for _, h, p in _ORDERED)} END AS rule,
          CASE {' '.join(f"WHEN {_FITS.format(h, p)} THEN '{v}'" for v, h, p in _ORDERED)}
               WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END AS verdict
        FROM c""",
    "op2_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
        f AS (SELECT k, min(doc_id) AS first FROM s GROUP BY k),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM s JOIN f USING (k) WHERE first < doc_id),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op3_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, sha256(array_to_string(w[i:i + 4], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS root FROM d UNION SELECT e.b AS a, r.root AS root FROM r JOIN e ON r.a = e.a WHERE r.root < e.b),
        m AS (SELECT a AS doc_id, min(root) AS component_id FROM r GROUP BY a)
        SELECT d.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id AS component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN m ON d.doc_id = m.doc_id""",
    "op5_sharding": """
        WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
        d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(doc_id AS UBIGINT) AS k FROM documents),
        b AS (SELECT doc_id, k, length(h) // 2 + 16 AS size, [4294967295] || list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM d),
        c AS (SELECT doc_id, k, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM b, t),
        m1 AS (SELECT *, CAST(CAST(xor(k, k >> 30) AS UHUGEINT) * 13787848793156543929 % 18446744073709551616 AS UBIGINT) AS x FROM c),
        m2 AS (SELECT *, CAST(CAST(xor(x, x >> 27) AS UHUGEINT) * 10723151780598845931 % 18446744073709551616 AS UBIGINT) AS y FROM m1),
        j AS (SELECT doc_id, n, xor(y, y >> 31) AS key, CAST(-1 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS later FROM m2, (VALUES (40), (41)) s(n)
            UNION ALL SELECT doc_id, n, z AS key, later AS shard, CAST(floor((later + 1) * (2147483648.0e0 / ((z >> 33) + 1.0e0))) AS BIGINT) AS later
            FROM (SELECT *, CAST((CAST(key AS UHUGEINT) * 2862933555777941757 + 1) % 18446744073709551616 AS UBIGINT) AS z FROM j WHERE later < n)),
        f AS (SELECT doc_id, CAST(max(shard) FILTER (n = 40) AS INTEGER) AS shard, CAST(max(shard) FILTER (n = 41) AS INTEGER) AS grown_shard FROM j GROUP BY doc_id)
        SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard FROM c JOIN f USING (doc_id)""",
    "op7_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
        bn AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
        sizes AS (SELECT DISTINCT n FROM bn),
        dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
        hits AS (SELECT doc_id, dw.n AS n, i, item FROM dw JOIN bw USING (n, k)),
        hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "C") AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)""",
}
ORACLE_SQL["op7_decontamination"] = ORACLE_SQL["op7_decontamination"].replace(' COLLATE "C"', "")
