"""Reading documents: binary files, recognised text by a pluggable recogniser, raw text and forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import extract_fields, with_report
from ..operators.ocrlines import normalise_lines

#: Characters of recognised text that leave a task at once, about.
SENT = 1 << 20
# Extensions of images.
IMAGES = [".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".webp"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def file_type(path: Column) -> Column:
    return F.when(extension(path) == ".pdf", "pdf").otherwise("image")


def handler(path: Column) -> Column:
    """How a stored file is read: image, pdf, or null for a kind that isn't supported."""
    return F.when(extension(path).isin(IMAGES), "image").when(extension(path) == ".pdf", "pdf")


def content_kind(content: Column) -> Column:
    """How bytes without a name are read: image by their first bytes, else pdf."""
    head = F.hex(F.substring(content, 1, 12))
    image = F.startswith(head, F.lit("FFD8FF")) | F.startswith(head, F.lit("89504E47")) | F.startswith(head, F.lit("424D")) | head.rlike("^(49492A00|4D4D002A)") | head.rlike("^52494646.{8}57454250")
    return F.when(image, "image").otherwise("pdf")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content, handler, error): files of unsupported kinds have an error, not an exception."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    how = handler(F.col("path"))
    return files.select("path", "length", "content", how.alias("handler"), F.when(how.isNull(), F.concat(F.lit("unsupported file type: "), extension(F.col("path")))).alias("error"))


def recognised_texts(result) -> list[str]:
    """Texts of a recogniser's result: items (box, (text, score)) or (box, text), one list of them or a list of lists; or objects with rec_texts."""
    out: list[str] = []

    def take(item) -> None:
        if isinstance(item, dict):
            out.extend(t.strip() for t in item.get("res", item).get("rec_texts", []) if isinstance(t, str) and t.strip())
        elif isinstance(item, list | tuple):
            second = item[1] if len(item) >= 2 else None
            text = second[0] if isinstance(second, list | tuple) and second else second
            if isinstance(text, str):
                if text.strip():
                    out.append(text.strip())
            else:
                for x in item:
                    take(x)

    for item in result or []:
        take(item)
    return out


def page_block(page: Column, text: Column) -> Column:
    return F.concat(F.lit("--- PAGE "), page.cast("string"), F.lit(" ---\n"), text)


def assemble_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page_no, text) to (key, raw_text), pages in order with their headings."""
    rows = F.array_sort(F.collect_list(F.struct("page_no", page_block(F.col("page_no"), F.coalesce("text", F.lit(""))).alias("block"))))
    return pages.groupBy(key).agg(F.array_join(rows["block"], "\n\n").alias("raw_text"))


def recognise(docs: DataFrame, make_reader: Callable[[str], Callable[[bytes, str], list[list[str]]]], lang: str = "en", key: str = "path") -> DataFrame:
    """(key, content, handler) to (key, handler, page_no, lines, error).

    make_reader(lang) is called once a task and gives read(content, handler), the lines of each page.
    What it raises becomes the row's error.
    """

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[key, "handler", "page_no", "lines", "error"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = None
        for batch in batches:
            rows, held = [], 0
            for k, content, how in zip(batch[key], batch["content"], batch["handler"], strict=True):
                try:
                    read = read or make_reader(lang)
                    new = [(k, how, i, [t for t in page if t.strip()], None) for i, page in enumerate(read(bytes(content), how), 1)]
                except Exception as e:  # noqa: BLE001  a document's failure is its own
                    new = [(k, how, 1, [], str(e) or type(e).__name__)]
                rows += new
                held += sum(64 + sum(map(len, r[3])) for r in new)
                if held >= SENT:
                    yield frame(rows)
                    rows, held = [], 0
            if rows:
                yield frame(rows)

    return docs.select(key, "content", "handler").mapInPandas(run, f"{key} string, handler string, page_no int, lines array<string>, error string")


def extract_text(docs: DataFrame, make_reader, lang: str = "en", key: str = "path") -> DataFrame:
    """(key, raw_text, error): lines of each page normalised; PDF pages get headings."""
    pages = recognise(docs.where("handler is not null"), make_reader, lang, key)
    pages = pages.select(key, "handler", "page_no", "error", F.array_join(normalise_lines("lines"), "\n").alias("text"))
    blocks = F.array_sort(F.collect_list(F.struct("page_no", F.when(F.col("handler") == "pdf", page_block(F.col("page_no"), F.col("text"))).otherwise(F.col("text")).alias("block"))))
    read = pages.groupBy(key).agg(F.array_join(blocks["block"], "\n\n").alias("raw_text"), F.max("error").alias("error"))
    if "error" in docs.columns:
        read = read.unionByName(docs.where("handler is null").select(key, F.lit(None).cast("string").alias("raw_text"), "error"))
    return read


def extract_and_map(docs: DataFrame, make_reader, lang: str = "en", key: str = "path") -> DataFrame:
    """Files to records in one plan: (key, raw_text, error), every field, how many there are and which are missing."""
    return with_report(extract_fields(extract_text(docs, make_reader, lang, key), kind=None))


def read_texts(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Raw text rows from JSON lines, Parquet, or whole text files."""
    if form == "text":
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("raw_text"))
    schema = "doc_id string, raw_text string, document_type string"
    return spark.read.schema(schema).json(path) if form == "json" else spark.read.format(form).load(path)


def read_forms(json_text: Column) -> Column:
    """A form in JSON as map<string,string>; null if it isn't JSON."""
    return F.from_json(json_text, "map<string,string>", {"mode": "PERMISSIVE"})
