"""Files as tables: listing, filters, routing by extension, and loaders."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import extension, html_text, stem

# Which extensions each route takes.
ROUTES = {
    "pdf": ("pdf",),
    "office": ("doc", "docx", "ppt", "pptx", "xls", "xlsx"),
    "html": ("html", "htm"),
    "image": ("png", "jpg", "jpeg", "gif", "bmp", "tiff"),
}
PLAIN = ("md", "yml", "yaml", "txt")


def list_files(spark: SparkSession, folders: list[str], *, content: bool = False) -> DataFrame:
    """(path, length, modified, ext[, content]) of all files below the folders; contents are only read if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), extension("path").alias("ext"), *(["content"] if content else []))


def without(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Without the paths in which any of the patterns is found."""
    for p in patterns:
        files = files.where(~F.col("path").rlike(p))
    return files


def of_types(files: DataFrame, types: list[str]) -> DataFrame:
    """Those with one of the extensions; ["all"] keeps every file."""
    return files if [t.lower() for t in types] == ["all"] else files.where(F.lower("ext").isin([t.lower() for t in types]))


def by_extension(files: DataFrame) -> DataFrame:
    """(ext, paths), paths sorted."""
    return files.groupBy("ext").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def routed(files: DataFrame) -> DataFrame:
    """files with route: pdf, office, html, image, or null for a type that isn't supported."""
    route = F.lit(None).cast("string")
    for name, types in ROUTES.items():
        route = F.when(F.col("ext").isin(*types), F.lit(name)).otherwise(route)
    return files.withColumn("route", route)


def rendered(files: DataFrame, renderer: Callable[[bytes, int], list[bytes]], dpi: int = 300) -> DataFrame:
    """(source, ext, page_number, image): pages from 1 that a renderer for the content makes; its failures are errors of the job."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                pages = renderer(row.content, dpi)
                yield pd.DataFrame({"source": row.path, "ext": row.ext, "page_number": range(1, len(pages) + 1), "image": pages})

    return files.select("path", "ext", "content").mapInPandas(run, "source string, ext string, page_number int, image binary")


def single_images(files: DataFrame) -> DataFrame:
    """Image files as one page each, without a page number."""
    return files.where(F.col("ext").isin(*ROUTES["image"])).select(F.col("path").alias("source"), "ext", F.lit(None).cast("int").alias("page_number"), F.col("content").alias("image"))


def converted(files: DataFrame, command: Callable[[str, str], list[str]], *, timeout: int = 60, strict: bool = False) -> DataFrame:
    """(path, ext, content) as an outside program converts it; command(in, out) gives its arguments. A failure drops the row, or is an error if strict."""
    import tempfile
    from pathlib import Path

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for row in part.itertuples():
                with tempfile.TemporaryDirectory() as d:
                    source, target = Path(d, f"in.{row.ext}"), Path(d, "out.pdf")
                    source.write_bytes(row.content)
                    try:
                        subprocess.run(command(str(source), str(target)), timeout=timeout, check=True, capture_output=True)
                        rows.append((row.path, "pdf", target.read_bytes()))
                    except (subprocess.SubprocessError, OSError):
                        if strict:
                            raise
            yield pd.DataFrame(rows, columns=["path", "ext", "content"])

    return files.select("path", "ext", "content").mapInPandas(run, "path string, ext string, content binary")


def loaded_text(files: DataFrame, *, fallback: Callable[[bytes, str], str] | None = None, strict: bool = False) -> DataFrame:
    """(source, ext, content, error): plain text, JSON as it stands, HTML without its tags; other types by a function of
    content and extension. A file that can't be read is an error if strict, else its content is null and error says why."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    plain = files.where(F.col("ext").isin(*PLAIN, "json", "csv", "tsv", "html", "htm"))
    read = F.when(F.col("ext").isin("html", "htm"), html_text(text)).otherwise(text)
    out = plain.select(F.col("path").alias("source"), "ext", read.alias("content"), F.when(text.isNull(), "not UTF-8").alias("error"))
    other = files.where(~F.col("ext").isin(*PLAIN, "json", "csv", "tsv", "html", "htm"))
    if fallback is None:
        rest = other.select(F.col("path").alias("source"), "ext", F.lit(None).cast("string").alias("content"), F.concat(F.lit("no loader for "), F.col("ext")).alias("error"))
    else:

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                rows = []
                for row in part.itertuples():
                    try:
                        rows.append((row.path, row.ext, fallback(row.content, row.ext), None))
                    except Exception as e:  # any loader, any error: it goes into the row
                        rows.append((row.path, row.ext, None, repr(e)))
                yield pd.DataFrame(rows, columns=["source", "ext", "content", "error"])

        rest = other.select("path", "ext", "content").mapInPandas(run, "source string, ext string, content string, error string")
    both = out.unionByName(rest)
    if strict:
        return both.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "source", "error"))).otherwise(F.lit(None).cast("string")))
    return both


def pages_of(texts: DataFrame, separator: str = "\f") -> DataFrame:
    """(source, page_number, content): text parted into pages at form feeds, numbered from 1."""
    return texts.select("source", F.posexplode(F.split("content", separator)).alias("p", "content")).select("source", (F.col("p") + 1).alias("page_number"), "content")


def tsv_collection(spark: SparkSession, path: str) -> DataFrame:
    """(pid, passage) of pid, passage and optional title; a title goes in front. Numbers that aren't those of the lines, 0 to n - 1, are an error."""
    rows = spark.read.option("sep", "\t").option("quote", "").schema("pid long, passage string, title string").csv(path)
    return checked_collection(rows.select("pid", F.concat_ws(" | ", "title", "passage").alias("passage")))


def checked_collection(rows: DataFrame) -> DataFrame:
    """Stops if the numbers of a collection aren't 0 to n - 1."""
    s = rows.agg(F.count("*").alias("n"), F.countDistinct("pid").alias("d"), F.min("pid").alias("a"), F.max("pid").alias("b")).first()
    if s["n"] and (s["a"] != 0 or s["b"] != s["n"] - 1 or s["d"] != s["n"]):
        raise ValueError("the passages' numbers must be their places")
    return rows


def write_preprocessed(pages: DataFrame, folder: str) -> None:
    """One text per source, pages in order, in a folder per base name."""
    whole = pages.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "content"))), lambda s: s["content"]), "").alias("value"))
    whole.select(F.concat(stem("source"), F.lit(".txt")).alias("name"), "value").write.mode("overwrite").partitionBy("name").text(folder)
