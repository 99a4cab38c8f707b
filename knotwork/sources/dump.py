"""XML dumps of a wiki: pages, site header, and their rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ENGLISH, NAMESPACES, UNPARSEABLE, Language
from ..functions import text as tx
from ..operators.titles import page_type
from ..storage import new_path

PAGE = "id LONG, ns INT, title STRING, redirect STRUCT<_title: STRING, _VALUE: STRING>, revision STRUCT<timestamp: STRING, text: STRUCT<_VALUE: STRING, _bytes: STRING>>"
SITE = "sitename STRING, dbname STRING, base STRING, `case` STRING, namespaces STRUCT<namespace: ARRAY<STRUCT<_key: INT, _case: STRING, _VALUE: STRING>>>"
SUFFIXES = (".xml", ".bz2", ".zst")


def readable(spark: SparkSession, path: str) -> str:
    """The path of a dump that Spark splits by pages. A .zst dump is unpacked to the shared folder first, as a stream."""
    if not path.rstrip("/").endswith(SUFFIXES):
        raise ValueError(f"a dump ends in one of {', '.join(SUFFIXES)}: {path}")
    if not path.endswith(".zst"):
        return path
    import zstandard

    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(new_path(spark, "dump") + ".xml")
    stream, out = source.getFileSystem(conf).open(source), target.getFileSystem(conf).create(target)
    unpack = zstandard.ZstdDecompressor().decompressobj()
    try:
        while chunk := bytes(stream.readNBytes(1 << 20)):
            if plain := unpack.decompress(chunk):
                out.write(bytearray(plain))
    finally:
        stream.close()
        out.close()
    return target.toString()


def site_info(spark: SparkSession, path: str) -> DataFrame:
    """(id, casing, name) of the namespaces in the header; an error if one that is needed is missing."""
    rows = spark.read.format("xml").option("rowTag", "siteinfo").schema(SITE).load(readable(spark, path))
    found = rows.select(F.explode("namespaces.namespace").alias("n")).select(F.col("n._key").alias("id"), casing(F.col("n._case")).alias("casing"), F.coalesce("n._VALUE", F.lit("")).alias("name")).distinct()
    have = {r["id"] for r in found.select("id").collect()}  # a few dozen rows
    if lost := sorted(set(NAMESPACES.values()) - have):
        raise ValueError(f"the header lacks namespaces {lost}")
    return found


def unseen_namespaces(pages: DataFrame, namespace: DataFrame) -> DataFrame:
    """(id, casing, name): namespaces that pages (namespace_id) stand in and that the header doesn't name."""
    used = pages.select(F.col("namespace_id").alias("id")).distinct().join(namespace.select("id"), "id", "left_anti")
    return used.select("id", F.lit("FIRST_LETTER").alias("casing"), F.lit("").alias("name"))


def casing(case: Column) -> Column:
    return F.when(case == "first-letter", "FIRST_LETTER").when(case == "case-sensitive", "CASE_SENSITIVE")


def page_rows(raw: DataFrame, language: Language = ENGLISH) -> DataFrame:
    """From rows of PAGE: (id, namespace_id, page_type, last_edited, markup_size, title, redirect_target, wikitext)."""
    wikitext = tx.markup_text(F.col("revision.text._VALUE"))
    rows = raw.select("id", F.col("ns").alias("namespace_id"), "title", F.col("redirect._title").alias("redirect_target"), wikitext.alias("wikitext"), F.unix_millis(F.to_timestamp("revision.timestamp")).alias("last_edited"))
    kind = page_type(F.col("namespace_id"), F.col("redirect_target"), tx.last_transclusion(F.col("wikitext")), language.disambiguation_prefixes)
    return rows.select("id", "namespace_id", kind.alias("page_type"), "last_edited", F.octet_length("wikitext").alias("markup_size"), "title", "redirect_target", "wikitext")


def read_pages(spark: SparkSession, path: str, language: Language = ENGLISH) -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(readable(spark, path))
    return page_rows(raw, language)


def unparseable(pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """Pages with markup that the parser gave up on get their type."""
    failed = parsed.where("wikitext is not null and text is null").select("id").withColumn("_failed", F.lit(True))
    return pages.join(failed, "id", "left").withColumn("page_type", F.when(F.col("_failed"), UNPARSEABLE).otherwise(F.col("page_type"))).drop("_failed")


def remaining(pages: DataFrame, *done: DataFrame) -> DataFrame:
    """Pages (id) that none of the stored tables (page_id) holds yet."""
    for d in done:
        pages = pages.join(d.select(F.col("page_id").alias("id")), "id", "left_anti")
    return pages


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def written_dump(rows: DataFrame) -> str:
    """Writes rows (id, ns, title, redirect, timestamp, text) as a dump, a folder of XML files; gives its path."""
    redirect = F.coalesce(F.concat(F.lit('<redirect title="'), escaped(F.col("redirect")), F.lit('"/>')), F.lit(""))
    page = F.concat(F.lit("<page><title>"), escaped(F.col("title")), F.lit("</title><ns>"), F.col("ns").cast("string"), F.lit("</ns><id>"), F.col("id").cast("string"), F.lit("</id>"), redirect, F.lit("<revision><timestamp>"), "timestamp", F.lit('</timestamp><text bytes="0">'), escaped(F.coalesce("text", F.lit(""))), F.lit("</text></revision></page>"))
    path = new_path(rows.sparkSession, "dump") + ".xml"

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(["<mediawiki>"])], names=["value"])
        yield from batches
        yield pa.RecordBatch.from_arrays([pa.array(["</mediawiki>"])], names=["value"])

    rows.select(page.alias("value")).mapInArrow(framed, "value string").write.text(path)
    return path
