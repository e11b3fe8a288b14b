"""Scans of raw files, pages, records, logs and state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators.extract import RECORD


def raw_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, source, sha256, bytes)`` of the PDF files of a folder, in any case of the extension; only the hash leaves the scan."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return files.select(T.base_name("path").alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).withColumn("source", T.source_slug("file"))


def pdf_pages(spark: SparkSession, folder: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """``(file, page_no, text)``; ``extract`` gives the texts of a PDF's pages, as no PDF library is part of the engine."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p.rsplit("/", 1)[-1], i, t) for p, c in zip(pdf["path"], pdf["content"]) for i, t in enumerate(extract(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["file", "page_no", "text"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder).select("path", "content").mapInPandas(run, "file string, page_no int, text string")


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("file").agg(F.max("page_no").alias("page_count"))


def extraction_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row a file ``<chunk_id>.json``; ``file_ord`` numbers them in name order within a source."""
    r = spark.read.schema(RECORD).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).withColumn("chunk_id", F.regexp_replace(T.base_name(F.col("_metadata.file_path")), r"\.json$", ""))
    return r.withColumn("file_ord", F.row_number().over(Window.partitionBy(T.chunk_source("chunk_id")).orderBy("chunk_id")))


def markdown_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, page)`` of all ``.md`` files below a folder, without its state folder and the root guide."""
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder)
    path = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/"), "^.*?" + "\\Q" + folder.rstrip("/").removeprefix("file://") + "/\\E", "")
    return df.select(path.alias("path"), F.col("value").alias("page")).where(~F.col("path").startswith(".state/") & (F.col("path") != "AGENTS.md"))


def section_pages(pages: DataFrame, section: str) -> DataFrame:
    """``(slug, locations)`` of the pages below a section, without indexes."""
    p = pages.where(F.col("path").startswith(section + "/") & ~F.col("path").endswith("index.md"))
    return p.groupBy(F.regexp_replace(T.base_name("path"), r"\.md$", "").alias("slug")).agg(F.array_sort(F.collect_list("path")).alias("locations"))


def split_frontmatter(pages: DataFrame) -> DataFrame:
    """pages(path, page) with ``yaml`` (null where there is none) and ``body``."""
    block = F.regexp_extract("page", r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    return pages.select("path", F.when(block != "", block).alias("yaml"), F.regexp_replace("page", r"(?s)\A---\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", "").alias("body"))


def _scalar(x: str):
    x = x.strip()
    if len(x) > 1 and x[0] == x[-1] and x[0] in "\"'":
        return json.loads(x) if x[0] == '"' else x[1:-1].replace("''", "'")
    if x.startswith("[") and x.endswith("]"):
        return [_scalar(p) for p in x[1:-1].split(",") if p.strip()]
    return {"": None, "null": None, "true": True, "false": False}.get(x, int(x) if x.lstrip("-").isdigit() else x)


def parse_yaml(text: str):
    """The part of YAML that frontmatter uses: nested maps and lists by indentation, quoted and plain scalars, inline lists."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#")]

    def block(i: int, indent: int):
        if i < len(lines) and lines[i][1].startswith("- ") or i < len(lines) and lines[i][1] == "-":
            out = []
            while i < len(lines) and lines[i][0] == indent and (lines[i][1].startswith("- ") or lines[i][1] == "-"):
                rest = lines[i][1][2:]
                key = rest.partition(": ")
                if key[1] or rest.endswith(":"):
                    lines[i] = (indent + 2, rest)
                    item, i = block(i, indent + 2)
                else:
                    item, i = _scalar(rest), i + 1
                out.append(item)
            return out, i
        out = {}
        while i < len(lines) and lines[i][0] == indent:
            key, mark, rest = lines[i][1].partition(":")
            if not mark:
                raise ValueError(f"no key: {lines[i][1]}")
            i += 1
            if rest.strip():
                out[key.strip()] = _scalar(rest)
            elif i < len(lines) and (lines[i][0] > indent or lines[i][1].startswith("- ") and lines[i][0] == indent):
                out[key.strip()], i = block(i, lines[i][0])
            else:
                out[key.strip()] = None
        return out, i

    found, i = block(0, lines[0][0] if lines else 0)
    if i < len(lines):
        raise ValueError(f"unexpected indentation: {lines[i][1]}")
    return found


FRONTMATTER = "title string, type string, wiki string, updated string, sources array<struct<file: string, pages: string>>, aliases array<string>, members array<struct<slug: string>>, class int, sparse boolean"


def frontmatter(pages: DataFrame) -> DataFrame:
    """pages(path, page) with the fields of FRONTMATTER and ``body``; what can't be parsed gives nulls."""
    @F.pandas_udf("string")
    def to_json(yaml: pd.Series) -> pd.Series:
        def one(x):
            try:
                return json.dumps(parse_yaml(x)) if x is not None else None
            except (ValueError, IndexError):
                return None

        return yaml.map(one, na_action="ignore")

    return split_frontmatter(pages).select("path", F.from_json(to_json("yaml"), FRONTMATTER).alias("f"), "body").select("path", "f.*", "body")


def section_bullets(pages: DataFrame, section: str) -> DataFrame:
    """``(path, pos, bullet)``: list items from ``## section`` to the next ``## ``."""
    lines = pages.select("path", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
    head = F.when(F.col("line").startswith("## "), T.strip(F.substr("line", F.lit(4))))
    now = lines.withColumn("section", F.last(head, ignorenulls=True).over(Window.partitionBy("path").orderBy("pos")))
    return now.where((F.col("section") == section) & F.col("line").rlike(r"^\s*[-*] ")).select("path", "pos", T.strip(F.regexp_replace("line", r"^\s*[-*] ", "")).alias("bullet"))


CALLS = "timestamp string, callType string, context string, provider string, model string, inputTokens bigint, outputTokens bigint, cost double"


def call_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; torn lines are left out."""
    return spark.read.schema(CALLS).option("mode", "DROPMALFORMED").json(path)


def state(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """A state file, or an empty table where there is none. A malformed one is an error, or with ``strict`` off skipped."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def folder_tree(pages: DataFrame) -> DataFrame:
    """``(folder, files, subfolders)`` in name order, without ``.state`` and ``raw``."""
    p = pages.where(~F.col("path").rlike(r"^(\.state|raw)/"))
    files = p.groupBy(T.folder_of("path").alias("folder")).agg(F.array_sort(F.collect_list(T.base_name("path"))).alias("files"))
    parts = F.split(T.folder_of("path"), "/")
    dirs = p.where(T.folder_of("path") != "").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("d")).distinct()
    subs = dirs.groupBy(T.folder_of("d").alias("folder")).agg(F.array_sort(F.collect_list(T.base_name("d"))).alias("subfolders"))
    every = dirs.select(F.col("d").alias("folder")).union(files.select("folder")).union(subs.select("folder")).distinct()
    return every.join(files, "folder", "left").join(subs, "folder", "left")
