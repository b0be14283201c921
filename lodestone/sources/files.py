"""Readers of scientific files: listings and text forms as DataFrame plans, binary forms by Arrow-batched parsing of `binaryFile` rows."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import with_rank

CELLS = "path string, x int, y int, v int"
FACETS = "path string, tri long, nx double, ny double, nz double, " + ", ".join(f"{c}{a} double" for c in "abc" for a in "xyz")


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, length and bytes of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)


def series_folders(files: DataFrame) -> DataFrame:
    """Folders that hold files with `DICM` at byte 128, with how many."""
    found = files.where(F.substring("content", 129, 4) == F.lit(b"DICM"))
    return found.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"))


def numbers_of(value: Column) -> Column:
    """A multi-valued tag: parts between backslashes as numbers, 0 for what isn't one."""
    return F.transform(F.split(value, r"\\"), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))


def stem_of(path: Column) -> Column:
    """File name without folder, ending (also .nii.gz) and a channel number of four digits."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(F.regexp_replace(name, r"(\.nii\.gz|\.[^.]*)$", ""), r"_\d{4}$", "")


def paired(images: DataFrame, labels: DataFrame) -> DataFrame:
    """case, image and label path: an equi-join of stems, the first image of each case."""
    i = images.select(stem_of(F.col("path")).alias("case"), F.col("path").alias("image")).groupBy("case").agg(F.min("image").alias("image"))
    return i.join(labels.select(stem_of(F.col("path")).alias("case"), F.col("path").alias("label")).groupBy("case").agg(F.min("label").alias("label")), "case")


def _parsed(files: DataFrame, fn, schema: str) -> DataFrame:
    """fn(path, content) gives a dict of columns; one file at a time is in memory."""
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                got = fn(content.as_py())
                n = len(next(iter(got.values())))
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * n) if c == "path" else pa.array(got[c]) for c in names], names=names)

    return files.select("path", "content").mapInArrow(run, schema)


def pgm(content: bytes) -> dict[str, np.ndarray]:
    """Cells of a binary grey map (P5); comments in the header are skipped."""
    at, found = 0, []
    while len(found) < 4:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
            continue
        end = at
        while not content[end : end + 1].isspace():
            end += 1
        found.append(content[at:end])
        at = end
    width, height = int(found[1]), int(found[2])
    v = np.frombuffer(content, np.uint8 if int(found[3]) < 256 else ">u2", width * height, at + 1)
    i = np.arange(width * height)
    return {"x": (i % width).astype(np.int32), "y": (i // width).astype(np.int32), "v": v.astype(np.int32)}


def read_pgm(files: DataFrame) -> DataFrame:
    return _parsed(files, pgm, CELLS)


def stl(content: bytes) -> dict[str, np.ndarray]:
    """Facets of a surface file, binary (by its length) or text."""
    n = struct.unpack_from("<I", content, 80)[0] if len(content) >= 84 else 0
    names = ["nx", "ny", "nz", *(c + a for c in "abc" for a in "xyz")]
    if n and len(content) == 84 + 50 * n:
        values = np.frombuffer(content, np.dtype([("f", "<f4", 12), ("a", "<u2")]), n, 84)["f"].astype(float)
    else:
        words = content.decode("ascii", "replace").split()
        values = np.array([float(w) for k, w in enumerate(words) if any(k - j >= 0 and words[k - j] in ("normal", "vertex") for j in (1, 2, 3))]).reshape(-1, 12)
    return {"tri": np.arange(len(values), dtype=np.int64)} | {name: values[:, k] for k, name in enumerate(names)}


def read_stl(files: DataFrame) -> DataFrame:
    return _parsed(files, stl, FACETS)


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """Rows (index, r, g, b) of a text colour table, in order; keywords and comments are skipped. Lines are read in
    splits and numbered by split and place."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*[-0-9.]")).select(F.monotonically_increasing_id().alias("at"), F.split(F.trim("value"), r"\s+").alias("p"))
    return with_rank(lines, "at", name="index").select("index", *[F.col("p")[k].cast("double").alias(c) for k, c in enumerate("rgb")])


def header_of(text: Column) -> Column:
    """A map of `Key = value` lines, as of raw-volume headers."""
    pairs = F.filter(F.split(text, r"\r?\n"), lambda s: s.contains("="))
    return F.map_from_entries(F.transform(pairs, lambda s: F.struct(F.trim(F.split(s, "=", 2)[0]), F.trim(F.split(s, "=", 2)[1]))))


#: What ends an article, and with it a record of the file (fixed value).
ARTICLE_END = "</PubmedArticle>"


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles of XML files of any size, which are read in splits that end with an article: pmid, title, abstract (sections
    as `LABEL: text`), journal, year, month, day and pub_date, authors, first_author, n_authors, doi, mesh_terms,
    keywords, publication_types, language, country."""
    raw = spark.read.option("lineSep", ARTICLE_END).text(path).where(F.col("value").contains("<PubmedArticle")).withColumnRenamed("value", "a")
    plain = lambda c: F.trim(F.regexp_replace(c, r"<[^>]+>", ""))
    one = lambda tag: plain(F.regexp_extract("a", rf"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>", 1))
    every = lambda tag: F.transform(F.regexp_extract_all("a", F.lit(rf"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>"), F.lit(1)), plain)
    sections = F.regexp_extract_all("a", F.lit(r"(?s)(<AbstractText(?: [^>]*)?>.*?</AbstractText>)"), F.lit(1))
    text = F.transform(sections, lambda s: F.concat(F.when(s.contains("Label="), F.concat(F.regexp_extract(s, 'Label="([^"]*)"', 1), F.lit(": "))).otherwise(""), plain(s)))
    authors = every("LastName")
    date = {k: one(t) for k, t in (("year", "Year"), ("month", "Month"), ("day", "Day"))}
    return raw.select(
        one("PMID").alias("pmid"), one("ArticleTitle").alias("title"), F.concat_ws(" ", text).alias("abstract"), one("Title").alias("journal"), *[c.alias(k) for k, c in date.items()],
        F.concat_ws(" ", *[F.when(c != "", c) for c in date.values()]).alias("pub_date"), F.concat_ws("; ", authors).alias("authors"), F.element_at(F.concat(authors, F.array(F.lit(""))), 1).alias("first_author"),
        F.size(authors).alias("n_authors"), F.regexp_extract("a", r'<ArticleId IdType="doi">([^<]*)<', 1).alias("doi"), *[F.concat_ws("; ", every(t)).alias(n) for n, t in (("mesh_terms", "DescriptorName"), ("keywords", "Keyword"), ("publication_types", "PublicationType"))],
        one("Language").alias("language"), one("Country").alias("country"),
    ).where("pmid <> ''")


def year_of(value: Column) -> Column:
    """A year from text, null for what isn't a number."""
    return F.trim(value).try_cast("double").cast("int")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, in UTF-8 with or without a byte order mark; types from the schema or from the data."""
    reader = spark.read.option("header", "true").option("multiLine", "false")
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", "true").csv(path)
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def config(spark: SparkSession, path: str) -> DataFrame:
    """Leaves of a configuration of nested `key: value` lines: key (its parents before it, with dots) and value; lists as
    their text. Comments and empty lines are skipped."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, values, parents = [], [], []
            for line in "\n".join(b.column("value").to_pylist()).splitlines():
                text = line.split(" #")[0].rstrip()
                if not text.strip() or text.lstrip().startswith("#") or ":" not in text:
                    continue
                depth = len(text) - len(text.lstrip())
                key, value = (x.strip() for x in text.split(":", 1))
                parents = [p for p in parents if p[0] < depth]
                if value:
                    keys.append(".".join([p[1] for p in parents] + [key]))
                    values.append(value.strip("\"'"))
                else:
                    parents.append((depth, key))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], names=["key", "value"])

    return spark.read.text(path, wholetext=True).mapInArrow(run, "key string, value string")


#: Types of cells by their code in a volume's header (fixed values of the published format).
_NIFTI = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def nifti(content: bytes) -> dict[str, np.ndarray]:
    """Cells (x, y, z, v) of a volume file, packed or not, with the header's scale."""
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    order = "<" if struct.unpack_from("<i", raw, 0)[0] == 348 else ">"
    dims = struct.unpack_from(f"{order}8h", raw, 40)
    nx, ny, nz = (max(1, d) for d in (*dims[1 : 1 + min(3, dims[0])], 1, 1, 1)[:3])
    kind, start = struct.unpack_from(f"{order}h", raw, 70)[0], int(struct.unpack_from(f"{order}f", raw, 108)[0])
    slope, intercept = struct.unpack_from(f"{order}2f", raw, 112)
    v = np.frombuffer(raw, order + _NIFTI[kind], nx * ny * nz, start).astype(float)
    i = np.arange(len(v))
    return {"x": (i % nx).astype(np.int32), "y": (i // nx % ny).astype(np.int32), "z": (i // (nx * ny)).astype(np.int32), "v": v * slope + intercept if slope else v}


def read_nifti(files: DataFrame) -> DataFrame:
    return _parsed(files, nifti, "path string, x int, y int, z int, v double")


#: Values with a length of four bytes, and the tags that a slice is read by (fixed values of the published format).
_LONG_VALUES = (b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN")
_TAGS = {(0x20, 0x0E): "series", (0x20, 0x13): "instance", (0x20, 0x32): "position", (0x20, 0x37): "orientation", (0x28, 0x30): "spacing", (0x28, 0x1052): "intercept", (0x28, 0x1053): "slope"}


def slice_header(content: bytes) -> tuple[dict[str, str], dict[str, int], bytes]:
    """Text tags, numbers (rows, columns, signed) and the pixels of a slice file with explicit little-endian values."""
    at, text, numbers, pixels = 132 if content[128:132] == b"DICM" else 0, {}, {}, b""
    while at + 8 <= len(content):
        tag = struct.unpack_from("<2H", content, at)
        kind = content[at + 4 : at + 6]
        size, at = (struct.unpack_from("<I", content, at + 8)[0], at + 12) if kind in _LONG_VALUES else (struct.unpack_from("<H", content, at + 6)[0], at + 8)
        if size == 0xFFFFFFFF:
            break
        value = content[at : at + size]
        at += size
        if tag in _TAGS:
            text[_TAGS[tag]] = value.decode("ascii", "replace").strip("\0 ")
        elif tag in ((0x28, 0x10), (0x28, 0x11), (0x28, 0x103)):
            numbers[{0x10: "rows", 0x11: "columns", 0x103: "signed"}[tag[1]]] = struct.unpack("<H", value[:2])[0]
        elif tag == (0x7FE0, 0x10):
            pixels = value
    return text, numbers, pixels


def slice_cells(content: bytes) -> dict[str, np.ndarray]:
    """Cells of a slice with its series, place along the slices' normal and scaled values; none if it isn't a slice."""
    text, numbers, pixels = slice_header(content)
    n = numbers.get("rows", 0) * numbers.get("columns", 0)
    n = n if len(pixels) >= 2 * n else 0
    raw = np.frombuffer(pixels, "<i2" if numbers.get("signed") else "<u2", n).astype(float)
    i = np.arange(n)
    width = max(1, numbers.get("columns", 1))
    position, axes = ([float(x) for x in text.get(k, "").split("\\") if x] for k in ("position", "orientation"))
    place = float(np.dot(np.cross(axes[:3], axes[3:6]), position)) if len(position) == 3 and len(axes) == 6 else float(text.get("instance") or 0)
    return {"series": [text.get("series", "")] * n, "instance": np.full(n, int(text.get("instance") or 0), np.int32), "place": np.full(n, place), "x": (i % width).astype(np.int32), "y": (i // width).astype(np.int32), "v": raw * float(text.get("slope") or 1) + float(text.get("intercept") or 0)}


def read_slices(files: DataFrame) -> DataFrame:
    """Cells of all slices of slice files: path, series, instance, place along the normal, x, y, v."""
    return _parsed(files, slice_cells, "path string, series string, instance int, place double, x int, y int, v double")


def series_summary(cells: DataFrame) -> DataFrame:
    """Slices, cells, places and values of each series."""
    return cells.groupBy("series").agg(F.count_distinct("path").alias("slices"), F.count("*").alias("cells"), F.min("place").alias("first"), F.max("place").alias("last"), F.min("v").alias("least"), F.max("v").alias("largest"))


def built_volume(cells: DataFrame, series: str) -> DataFrame:
    """The cells of one series as a volume: slices numbered by place and then instance."""
    slices = cells.where(F.col("series") == series).select("path", "place", "instance").distinct()
    numbered = slices.withColumn("z", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("place", "instance", "path")) - 1)
    return cells.where(F.col("series") == series).join(F.broadcast(numbered.select("path", "z")), "path").select("x", "y", "z", "v")


def latest_json(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Records of the last file by name."""
    last = listing(spark, folder, glob).agg(F.max("path")).first()[0]
    return spark.read.json(last, multiLine=True)


def query_text(groups: list[list[str]], field: str = "Title/Abstract") -> str:
    """A boolean query: every group must match, by any of its terms."""
    return " AND ".join("(" + " OR ".join(f'"{t}"[{field}]' for t in g) + ")" for g in groups if g)


def matches_query(text: Column, groups: list[list[str]]) -> Column:
    """The same as a predicate over a text column."""
    out = F.lit(True)
    for g in groups:
        any_ = F.lit(False)
        for t in g:
            any_ = any_ | F.lower(text).contains(t.lower())
        out = out & any_
    return out
