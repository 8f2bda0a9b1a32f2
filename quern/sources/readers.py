"""Sources: article files, logs, tables of several formats. Schemas are given, never inferred."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quern.functions import text as X

#: Cell texts read as null.
NULL_WORDS = ["", "#N/A", "N/A", "NA", "NULL", "NaN", "None", "nan", "null", "<NA>", "n/a"]


def strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def csv(spark: SparkSession, path: str, schema: T.StructType, null_words: bool = True) -> DataFrame:
    """A CSV with header, quoted line breaks and doubled quotes; with null_words, the words for missing become null. Cells
    that don't fit their type are null."""
    raw = spark.read.csv(path, schema=strings([f.name for f in schema]), header=True, multiLine=True, escape='"', encoding="UTF-8")
    # a byte order mark may sit before the first header only, and columns go by place
    value = lambda f: F.when(~F.trim(F.col(f.name)).isin(NULL_WORDS), F.col(f.name)) if null_words else F.coalesce(F.col(f.name), F.lit(""))
    return raw.select([value(f).try_cast(f.dataType).alias(f.name) for f in schema])


def json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of each .pdf below the folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(folder).select("path", "length", "content")


def parse_pdfs(files: DataFrame, parser: Callable[[], Callable[[bytes], str]]) -> DataFrame:
    """(path, markdown, error): parser makes a function from bytes to Markdown in each task; failures and empty results give
    an error instead."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = parser()
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"]):
                try:
                    text = parse(bytes(content))
                    rows.append((p, text or None, None if text else "empty"))
                except Exception as e:  # noqa: BLE001
                    rows.append((p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "markdown", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, markdown string, error string")


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, title, link, path, body) of each .md file's front matter and body, by path."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).withColumn("file", F.input_file_name()).orderBy("file")
    v = F.col("value")
    return raw.select("file", X.front_matter(v, "title").alias("title"), X.front_matter(v, "link").alias("link"), X.front_matter(v, "path").alias("path"), X.body(v).alias("body"))


def bibtex(spark: SparkSession, path: str) -> DataFrame:
    """(title, abstract) of each @inproceedings entry."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(@inproceedings\{[^@]*\})"), 1)).alias("entry"))
    value = lambda k: F.regexp_extract("entry", rf"(?is)\b{k}\s*=\s*[\{{\"](.*?)[\}}\"]\s*[,}}]", 1)
    return blocks.select(value("title").alias("title"), value("abstract").alias("abstract"))


def about(df: DataFrame, words: list[str], columns: list[str]) -> DataFrame:
    """Rows in which one of the words occurs in one of the columns, letter case aside."""
    whole = F.lower(F.concat_ws("\n", *columns))
    return df.where(F.greatest(*[whole.contains(w.lower()) for w in words], F.lit(False)))


def _found(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What read() gives, or None where its path doesn't exist, on whatever store."""
    try:
        df = read()
        df.schema
        return df
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def benchmark_pairs(spark: SparkSession, path: str | None, low: float, high: float, fallback: list[tuple[str, str, float]], cache: str | None = None) -> DataFrame:
    """(sentence1, sentence2, score from 0 to 5): from the cache, a parquet table, where there is one; else from parquet or CSV at
    the path, which is then written to the cache; else the fallback, which never is."""
    if cache and (kept := _found(lambda: spark.read.parquet(cache))) is not None:
        return kept
    raw = path and _found(lambda: spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else csv(spark, path, T.StructType.fromDDL("sentence1 string, sentence2 string, score double")))
    if raw is None or not path:
        return spark.createDataFrame(fallback, "sentence1 string, sentence2 string, score double")
    pairs = raw.select("sentence1", "sentence2", X.rescale(F.col("score"), low, high).alias("score"))
    if cache:
        pairs.write.mode("overwrite").parquet(cache)
        return spark.read.parquet(cache)
    return pairs


def pdf_pages(files: DataFrame, tool: Callable[[], Callable[[bytes], tuple[str, str]]]) -> DataFrame:
    """(path, page, document_title, error): tool makes a function from bytes to the text of the first pages and the document's
    information, of whose lines the one that starts with Title: gives the title."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = tool()
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"]):
                try:
                    page, info = read(bytes(content))
                    title = next((x.split(":", 1)[1].strip() for x in (info or "").splitlines() if x.startswith("Title:")), "")
                    rows.append((p, page or "", title, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((p, "", "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page", "document_title", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, page string, document_title string, error string")


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _cells(path: str, sheet: str) -> list[list[str]]:
    """The stripped texts of a sheet's rows, by the workbook's own XML."""
    with zipfile.ZipFile(path) as z:
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        names = {s.get("name"): links[s.get(_LINK)] for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")}
        if sheet not in names:
            raise ValueError(f"no sheet {sheet}; there are {sorted(names)}")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        target = names[sheet].lstrip("/")
        rows = []
        for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_SHEET}row"):
            cells: dict[int, str] = {}
            for c in row.iter(f"{_SHEET}c"):
                letters = re.match("[A-Z]*", c.get("r") or "")[0]
                at = reduce(lambda n, x: n * 26 + ord(x) - 64, letters, 0) - 1 if letters else len(cells)
                value = c.find(f"{_SHEET}v")
                if c.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
                else:
                    text = "" if value is None or value.text is None else shared[int(value.text)] if c.get("t") == "s" else value.text
                cells[at] = text.strip()
            rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
    return rows


def workbook(spark: SparkSession, path: str, sheet: str, key: str = "item_id") -> DataFrame:
    """A sheet's cells as stripped strings, the header in the first row; rows with a blank key are dropped. A workbook is one
    local file, which the driver reads."""
    rows = _cells(path, sheet)
    head = rows[0] if rows else []
    body = [(r + [""] * len(head))[: len(head)] for r in rows[1:]]
    return spark.createDataFrame([tuple(r) for r in body], strings(head)).where(F.col(key) != "")
