"""File listings and metadata of EPUB files."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from folioforge.functions.text import clean, clean_series, parse_volume
from folioforge.functions.titles import strip_artifacts

# Book file extensions.
EXTENSIONS = ["epub", "mobi", "azw", "azw3", "pdf", "lit", "fb2", "rtf", "txt"]
_TEXTS = T.ArrayType(T.StringType())
METADATA = T.StructType([T.StructField(n, k) for n, k in (("title", T.StringType()), ("creators", _TEXTS), ("identifiers", _TEXTS), ("subjects", _TEXTS), ("series", T.StringType()), ("series_index", T.StringType()), ("error", T.StringType()))])
_ARROW = pa.struct([("title", pa.string()), ("creators", pa.list_(pa.string())), ("identifiers", pa.list_(pa.string())), ("subjects", pa.list_(pa.string())), ("series", pa.string()), ("series_index", pa.string()), ("error", pa.string())])


def book_files(spark: SparkSession, folder: str, recursive: bool = True, with_epub: bool = True) -> DataFrame:
    """(path, size, modified) of the book files of a folder, without their content, in order of path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.where(ext.isin([e for e in EXTENSIONS if with_epub or e != "epub"])).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy(F.lower("path"))


def name_parts(path: Column) -> Column:
    """struct<stem, segments, core> of a path: segments stand between double hyphens."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[A-Za-z0-9]+$", "")
    segments = F.filter(F.transform(F.split(stem, r"\s*--\s*"), strip_artifacts), lambda x: x != "")
    return F.struct(stem.alias("stem"), segments.alias("segments"), F.coalesce(F.try_element_at(segments, F.lit(1)), stem).alias("core"))


# Names of the series and of the place in it, the first that has a value counts.
_SERIES, _INDEX = ("calibre:series", "series", "belongs-to-collection"), ("calibre:series_index", "series_index", "group-position")


def read_epub(content: bytes | None) -> dict:
    """Metadata of one EPUB; a failure gives empty fields and its text in ``error``."""
    out: dict = {"title": None, "creators": [], "identifiers": [], "subjects": [], "series": None, "series_index": None, "error": None}
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            container = ElementTree.fromstring(z.read("META-INF/container.xml"))
            package = next(e.attrib["full-path"] for e in container.iter() if e.tag.endswith("rootfile"))
            root = ElementTree.fromstring(z.read(package))
    except Exception as e:  # a broken file is data, not a failure of the job
        return out | {"error": f"epub-read: {e}"}
    lists = {"creator": "creators", "identifier": "identifiers", "subject": "subjects"}
    told: dict[str, str] = {}
    for e in root.iter():
        tag, text = e.tag.rpartition("}")[2], " ".join((e.text or "").split())
        if tag == "title" and text and out["title"] is None:
            out["title"] = text
        elif tag in lists and text:
            out[lists[tag]].append(text)
        elif tag == "meta" and (value := e.attrib.get("content") or text):
            told.setdefault(e.attrib.get("name") or e.attrib.get("property") or "", value)
    first = lambda names: next((told[n] for n in names if n in told), None)
    return out | {"series": first(_SERIES), "series_index": first(_INDEX)}


@F.arrow_udf(METADATA)
def _read(content: pa.Array) -> pa.Array:
    return pa.array([read_epub(c) for c in content.to_pylist()], _ARROW)


def book_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """One row per book file below a folder, with what its name and, of an EPUB, its package say.

    Only EPUB files are opened; a broken one keeps its row with a text in ``errors``.
    """
    c = F.col
    files = book_files(spark, folder).select("path", name_parts(c("path")).alias("n")).select("path", "n.*")
    bodies = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[eE][pP][uU][bB]").load(folder).select("path", _read("content").alias("m"))
    listed = lambda x: F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), clean), lambda v: v != "")
    return files.join(bodies, "path", "left").select(
        "path", "stem", "segments", "core", clean(c("m.title")).alias("title"), listed(c("m.creators")).alias("creators"), listed(c("m.identifiers")).alias("identifiers"), listed(c("m.subjects")).alias("subjects"),
        clean_series(c("m.series")).alias("meta_series"), parse_volume(c("m.series_index")).alias("meta_volume"), F.array_compact(F.array("m.error")).alias("errors"))
