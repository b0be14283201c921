"""Queries of file sources and sinks: tables are written to the shared folder, or bytes are made from them, and read back."""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import functions as F

from ..operators import volumes as U  # noqa: N812
from ..sources import files as S  # noqa: N812
from ..sources import sinks as W  # noqa: N812
from ..storage import shared_dir
from .evidence_queries import rounded
from .image_queries import _r
from .tables import table
from .voxel_queries import _VOL, volume


def _place(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def csv_round_trip(spark, sf_dir):
    at = _place(spark)
    W.write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), at)
    return S.read_csv(spark, at, "p_partkey long, p_name string, p_size int, p_retailprice double")


def newest_json(spark, sf_dir):
    at = _place(spark)
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") > 1, F.col("n_regionkey")).alias("big"))
    W.write_json(rows.where("n_nationkey = 0").coalesce(1), f"{at}/results_1")
    W.write_json(rows.coalesce(1), f"{at}/results_2")
    return spark.read.schema("n_nationkey int, n_name string, big int").json(S.listing(spark, at, "*.json").agg(F.max("path")).first()[0])


def article_source(spark, sf_dir):
    at, k = _place(spark), F.col("c_custkey")
    xml = F.format_string(
        '<PubmedArticle><PMID Version="1">%d</PMID><Article><Journal><Title>J %d</Title><PubDate><Year>%d</Year><Month>Mar</Month></PubDate></Journal><ArticleTitle>On <i>%s</i></ArticleTitle>'
        '<Abstract><AbstractText Label="AIM">To see.</AbstractText><AbstractText>Balance %.2f.</AbstractText></Abstract><Author><LastName>A%d</LastName></Author><Author><LastName>B</LastName></Author><Language>eng</Language></Article>'
        '<DescriptorName UI="D1">%s</DescriptorName><DescriptorName>All</DescriptorName><ArticleId IdType="doi">10.1/%d</ArticleId></PubmedArticle>',
        k, k % 7, 2000 + k % 20, F.col("c_name"), F.col("c_acctbal"), k % 5, F.col("c_mktsegment"), k,
    )
    table(spark, sf_dir, "customer").select(xml.alias("value")).write.text(at)
    found = S.articles(spark, at)
    return found.select(F.col("pmid").cast("long").alias("pmid"), "title", "abstract", "journal", S.year_of(F.col("year")).alias("year"), "pub_date", "authors", "first_author", "n_authors", "doi", "mesh_terms", "language")


def search_predicate(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(S.matches_query(F.col("text"), [["license", "the"], ["and", "von"]])).groupBy("lang").agg(F.count("*").alias("n"))


def grey_maps(spark, sf_dir):
    """Each vector as a map of 8 x 8 cells."""
    level = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v * 100 + 128))).cast("int")
    cells = F.transform("embedding", lambda v: F.lpad(F.hex(level(v.cast("double"))), 2, "0"))
    content = F.unhex(F.concat(F.hex(F.encode(F.lit("P5\n# made\n8 8\n255\n"), "UTF-8")), F.array_join(cells, "")))
    files = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id")).alias("path"), content.alias("content"))
    return S.read_pgm(files).groupBy("path").agg(F.sum(F.col("v") * (F.col("x") + 1)).alias("across"), F.sum(F.col("v") * (F.col("y") + 1)).alias("down"))


def surfaces(spark, sf_dir):
    """A text surface of one facet for each supplier."""
    k = F.col("s_suppkey")
    text = F.format_string("solid s\nfacet normal 0 0 1\nouter loop\nvertex %d 0 0\nvertex 0 %d 0\nvertex 1 1 %.2f\nendloop\nendfacet\nendsolid s\n", k, k * 2, F.col("s_acctbal"))
    files = table(spark, sf_dir, "supplier").select(k.cast("string").alias("path"), F.encode(text, "UTF-8").alias("content"))
    return S.read_stl(files).select("path", "tri", "nz", "ax", "by", "cz")


def colour_table(spark, sf_dir):
    at = _place(spark)
    lines = spark.range(0, 512, 1, 1).select(F.when(F.col("id") == 0, F.lit("LUT_3D_SIZE 8\n# made\n0 0 0")).otherwise(F.format_string("%.4f %.4f %.4f", F.col("id") % 8 / 7.0, F.floor(F.col("id") / 8) % 8 / 7.0, F.floor(F.col("id") / 64) / 7.0)).alias("value"))
    lines.write.text(at)
    return rounded(S.read_cube(spark, at), 4)


def raw_headers(spark, sf_dir):
    text = F.format_string("ObjectType = Image\nDimSize = %d %d 1\nElementSpacing = 0.5 0.5 %.2f\nElementDataFile = p%d.raw", F.col("p_size"), F.col("p_size") * 2, F.col("p_retailprice"), F.col("p_partkey"))
    h = table(spark, sf_dir, "part").select("p_partkey", S.header_of(text).alias("h"))
    return h.select("p_partkey", F.col("h")["DimSize"].alias("dims"), S.numbers_of(F.regexp_replace(F.col("h")["ElementSpacing"], " ", r"\\"))[2].alias("gap"), S.stem_of(F.col("h")["ElementDataFile"]).alias("stem"))


def settings(spark, sf_dir):
    at = _place(spark)
    text = "# run\nmodel:\n  size: 64\n  loss:\n    name: 'ncc'\n    window: 9\ndata:\n  paths: [a, b]\nseed: 42 # fixed\n"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(at)
    return S.config(spark, at)


def packed_volumes(spark, sf_dir):
    """Volume files of 8 x 8 x 1 cells, made from the vectors."""
    header = bytearray(352)
    struct.pack_into("<i", header, 0, 348)
    struct.pack_into("<8h", header, 40, 3, 8, 8, 1, 1, 1, 1, 1)
    struct.pack_into("<h", header, 70, 2)
    struct.pack_into("<3f", header, 108, 352.0, 0.5, -3.0)
    level = F.transform("embedding", lambda v: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 100 + 128)))), 2, "0"))
    files = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id")).alias("path"), F.unhex(F.concat(F.lit(bytes(header).hex()), F.array_join(level, ""))).alias("content"))
    return S.read_nifti(files).groupBy("path").agg(F.sum(F.col("v") * (F.col("x") + 1)).alias("across"), F.sum(F.col("v") * (F.col("y") + 1)).alias("down"))


def _tag(group: int, element: int, kind: str, value):
    """A value of a slice file in hexadecimal digits; text is padded to an even length."""
    text = F.when(F.length(value) % 2 == 1, F.concat(value, F.lit(" "))).otherwise(value)
    size = F.length(text)
    return F.concat(F.lit(struct.pack("<2H", group, element).hex() + kind.encode().hex()), F.lpad(F.hex(size % 256), 2, "0"), F.lpad(F.hex(F.floor(size / 256)), 2, "0"), F.hex(F.encode(text, "UTF-8")))


def slice_series(spark, sf_dir):
    """Slice files of 8 x 8 cells; a series is a label of vectors, its slices stand at places that fall with the id."""
    cells = F.transform("embedding", lambda v: F.concat(F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 100 + 128)))), 2, "0"), F.lit("00")))
    k = F.col("vec_id")
    content = F.concat(
        F.lit("00" * 128 + b"DICM".hex()), _tag(0x20, 0x0E, "UI", F.concat(F.lit("1.2."), F.col("label"))), _tag(0x20, 0x13, "IS", k.cast("string")), _tag(0x20, 0x32, "DS", F.concat(F.lit("0\\0\\"), F.format_string("%.1f", k * -1.5))),
        _tag(0x20, 0x37, "DS", F.lit("1\\0\\0\\0\\1\\0")), F.lit("28001000555302000800"), F.lit("28001100555302000800"), _tag(0x28, 0x1052, "DS", F.lit("-100")), _tag(0x28, 0x1053, "DS", F.lit("2")),
        F.lit("e07f10004f570000" + struct.pack("<I", 128).hex()), F.array_join(cells, ""),
    )
    files = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("f/"), F.col("label"), F.lit("/"), k).alias("path"), F.unhex(content).alias("content"))
    counts = S.series_folders(files).select(F.regexp_extract("folder", r"(\d+)$", 1).alias("f"), "files")
    found = S.series_summary(S.read_slices(files)).withColumn("f", F.regexp_extract("series", r"(\d+)$", 1))
    top = S.built_volume(S.read_slices(files), "1.2.1").agg(F.sum(F.col("v") * F.col("z")).alias("moment"))
    return rounded(found.join(counts, "f").join(F.broadcast(top)).select("series", "slices", "files", "cells", "first", "last", "least", "largest", F.when(F.col("series") == "1.2.1", F.col("moment")).alias("moment")), 4)


def tool_paths(spark, sf_dir):
    e = F.col("event_id")
    seg = table(spark, sf_dir, "events").select(F.col("user_id").alias("layer"), e.alias("seq"), (e % 3).cast("double").alias("x0"), F.lit(1.0).alias("y0"), ((e + 1) % 3).cast("double").alias("x1"), F.lit(1.0).alias("y1"), F.lit(0.25).alias("e"))
    return W.tool_path(seg).select("layer", "seq", "part", "line")


def mask_numbers(spark, sf_dir):
    return rounded(W.mask_summary(volume(spark, sf_dir)), 8)


def uptake_maps(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", U.linear_map(F.col("s_acctbal"), 0.25, -12.5).alias("u"))
    return rounded(s.select("s_suppkey", "u", U.inverse_map(F.col("u"), 0.25, -12.5).alias("back"), U.inverse_map(F.col("u"), 0.0, 1.0).alias("flat")), 6)


def results_text(spark, sf_dir):
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n")).orderBy("region")
    doc = W.results_document({"regions": n.coalesce(1)})
    return doc.select(F.explode(F.from_json("document", "regions array<struct<region:int,n:long>>")["regions"]).alias("x")).select("x.*")


QUERIES = {
    "csv_source": csv_round_trip, "json_source": newest_json, "article_source": article_source, "search_predicate": search_predicate, "grey_map_source": grey_maps, "surface_source": surfaces, "colour_table_source": colour_table,
    "raw_headers": raw_headers, "settings_source": settings, "packed_volume_source": packed_volumes, "slice_source": slice_series, "tool_path_lines": tool_paths, "mask_summary": mask_numbers, "uptake_maps": uptake_maps, "results_document": results_text,
}

_LEVEL = "greatest(0, least(255, CAST(floor(v * 100 + 128) AS INTEGER)))"

ORACLE_SQL = {
    "csv_source": "SELECT p_partkey, p_name, p_size, p_retailprice FROM part",
    "json_source": "SELECT n_nationkey, n_name, CASE WHEN n_regionkey > 1 THEN n_regionkey END AS big FROM nation",
    "article_source": """SELECT c_custkey AS pmid, 'On ' || c_name AS title, 'AIM: To see. Balance ' || printf('%.2f', c_acctbal) || '.' AS abstract, 'J ' || (c_custkey % 7) AS journal, CAST(2000 + c_custkey % 20 AS INTEGER) AS year,
        (2000 + c_custkey % 20) || ' Mar' AS pub_date, 'A' || (c_custkey % 5) || '; B' AS authors, 'A' || (c_custkey % 5) AS first_author, CAST(2 AS INTEGER) AS n_authors, '10.1/' || c_custkey AS doi, c_mktsegment || '; All' AS mesh_terms, 'eng' AS language FROM customer""",
    "search_predicate": "SELECT lang, count(*) AS n FROM documents WHERE (contains(lower(text), 'license') OR contains(lower(text), 'the')) AND (contains(lower(text), 'and') OR contains(lower(text), 'von')) GROUP BY lang",
    "grey_map_source": f"WITH {_VOL} SELECT 'v' || z AS path, CAST(sum({_LEVEL} * (x + 1)) AS BIGINT) AS across, CAST(sum({_LEVEL} * (y + 1)) AS BIGINT) AS down FROM vol GROUP BY z",
    "surface_source": "SELECT CAST(s_suppkey AS VARCHAR) AS path, CAST(0 AS BIGINT) AS tri, 1.0e0 AS nz, CAST(s_suppkey AS DOUBLE) AS ax, CAST(s_suppkey * 2 AS DOUBLE) AS by, CAST(printf('%.2f', s_acctbal) AS DOUBLE) AS cz FROM supplier",
    "colour_table_source": """SELECT range AS index, round(range % 8 / 7.0e0, 4) + 0.0e0 AS r, round(range // 8 % 8 / 7.0e0, 4) + 0.0e0 AS g, round(range // 64 / 7.0e0, 4) + 0.0e0 AS b FROM range(512)""",
    "raw_headers": "SELECT p_partkey, p_size || ' ' || (p_size * 2) || ' 1' AS dims, CAST(printf('%.2f', p_retailprice) AS DOUBLE) AS gap, 'p' || p_partkey AS stem FROM part",
    "settings_source": "SELECT * FROM (VALUES ('model.size', '64'), ('model.loss.name', 'ncc'), ('model.loss.window', '9'), ('data.paths', '[a, b]'), ('seed', '42')) AS t(key, value)",
    "packed_volume_source": f"WITH {_VOL} SELECT 'v' || z AS path, sum(({_LEVEL} * 0.5e0 - 3) * (x + 1)) AS across, sum(({_LEVEL} * 0.5e0 - 3) * (y + 1)) AS down FROM vol GROUP BY z",
    "slice_source": f"""WITH {_VOL}, e AS (SELECT vec_id, label FROM embeddings), c AS (SELECT label, z, {_LEVEL} * 2 - 100 AS s FROM vol JOIN e ON vec_id = z), o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC) - 1 AS k FROM e WHERE label = 1),
        m AS (SELECT CAST(sum(s * k) AS DOUBLE) AS moment FROM c JOIN o ON vec_id = z)
        SELECT '1.2.' || label AS series, count(DISTINCT z) AS slices, count(DISTINCT z) AS files, count(*) AS cells, min(z * -1.5e0) + 0.0e0 AS first, max(z * -1.5e0) + 0.0e0 AS last, CAST(min(s) AS DOUBLE) AS least, CAST(max(s) AS DOUBLE) AS largest, CASE WHEN label = 1 THEN any_value(moment) END AS moment FROM c, m GROUP BY label""",
    "tool_path_lines": """WITH s AS (SELECT user_id AS layer, event_id AS seq, event_id % 3 AS x0, (event_id + 1) % 3 AS x1, lag((event_id + 1) % 3) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events),
        l AS (SELECT layer, seq, CASE WHEN was IS NULL OR was <> x0 THEN [printf('G0 X%.3f Y%.3f', CAST(x0 AS DOUBLE), 1.0e0)] ELSE [] END || [printf('G1 X%.3f Y%.3f E%.5f F%d', CAST(x1 AS DOUBLE), 1.0e0, 0.25e0, 1800)] AS lines FROM s)
        SELECT layer, seq, CAST(k AS INTEGER) AS part, lines[k + 1] AS line FROM (SELECT layer, seq, lines, unnest(range(len(lines))) AS k FROM l)""",
    "mask_summary": f"WITH {_VOL} SELECT count(*) FILTER (v > 0) AS voxel_count, {_r('count(*) FILTER (v > 0) / count(*)', 'ratio')} FROM vol",
    "uptake_maps": f"SELECT s_suppkey, {_r('s_acctbal * 0.25e0 - 12.5e0', 'u', 6)}, {_r('s_acctbal', 'back', 6)}, 0.0e0 AS flat FROM supplier",
    "results_document": "SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1",
}
