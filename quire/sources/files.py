"""Readers of the service's files, and its document sink."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import filename_safe

MOST_PAGES = 10  # fixed value: pages of a document that are converted
IMAGES = "*.{png,jpg,jpeg,bmp,gif,webp,tif,tiff}"


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file that holds one array of rows."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def tex_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(key, tex) of every .tex file of a folder."""
    files = spark.read.option("pathGlobFilter", "*.tex").text(folder, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.tex\z", 1).alias("key"), F.col("value").alias("tex"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of the images of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", IMAGES).option("recursiveFileLookup", True).load(folder).select("path", "length", "content")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all files; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")


def references(sources: DataFrame, patterns: list[str], excluded: str) -> DataFrame:
    """(path, file) for every path that a source (file, text) names by one of the patterns' first groups, each once."""
    found = F.flatten(F.array(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in patterns)))
    return sources.select("file", F.explode(F.array_distinct(found)).alias("path")).where(~F.col("path").rlike(excluded)).distinct()


def missing_references(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, files): named paths that don't exist, with who names them."""
    return refs.join(files.select("path"), "path", "left_anti").groupBy("path").agg(F.sort_array(F.collect_set("file")).alias("files"))


def rewritten(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The path after the first rule (pattern, replacement) that matches it."""
    out = None
    for pattern, to in rules:
        hit = F.regexp_replace(path, pattern, to)
        out = F.when(path.rlike(pattern), hit) if out is None else out.when(path.rlike(pattern), hit)
    return path if out is None else out.otherwise(path)


def units(docs: DataFrame) -> DataFrame:
    """(doc, total, dropped, unit) for each page of docs (doc, total) that is converted; a document whose pages couldn't be counted (null) has one."""
    total = F.coalesce(F.col("total"), F.lit(1))
    kept = F.greatest(F.least(total, F.lit(MOST_PAGES)), F.lit(1))
    return docs.select("doc", total.alias("total"), F.greatest(F.lit(0), total - MOST_PAGES).alias("dropped"), F.explode(F.sequence(F.lit(1), kept)).alias("unit"))


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (name, content) as files of these names into a folder, a URI that pyarrow can open; gives (name, bytes).

    A file is written under a name of its attempt and then moved, so a task that
    runs again, or twice, leaves one whole file. Of equal names the last one moved
    stays. Runs when the result is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{root}/.{attempt}.{name}") as f:
                    f.write(content)
                store.move(f"{root}/.{attempt}.{name}", f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(b.column(1)).cast(pa.int64())], names=["name", "bytes"])

    return rows.select("name", F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content")).mapInArrow(run, "name string, bytes bigint")


def write_tex(docs: DataFrame, folder: str) -> DataFrame:
    """Writes docs (name, tex) as name.tex, the name made safe; gives (name, bytes)."""
    return write_files(docs.select(F.concat(filename_safe(F.col("name")), F.lit(".tex")).alias("name"), F.col("tex").alias("content")), folder)
