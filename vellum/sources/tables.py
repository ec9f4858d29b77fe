"""Sources of the canonical relations: plain text, web pages, specs, ignore lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def blocks_of_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """One block a line: doc_id, ord, kind, para_index (from 1), text, style_name. The lines stay with their document."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("k", "line"))
    n = (F.col("k") + 1).cast("int")
    return lines.select("doc_id", n.alias("ord"), F.lit("p").alias("kind"), n.alias("para_index"), F.col("line").alias("text"), F.lit("正文文本").alias("style_name"))


def page_parts(pages: DataFrame) -> DataFrame:
    """Title, first h1, navigation flag and tag counts of each page, by patterns that stay inside Spark's expressions."""
    h = F.coalesce(F.col("html"), F.lit(""))
    clean = lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))
    count = lambda p: F.regexp_count(h, F.lit(p)).cast("long")
    return pages.select(
        "page_id",
        "url",
        clean(F.regexp_extract(h, r"(?is)<title>(.*?)</title>", 1)).alias("title"),
        clean(F.regexp_extract(h, r"(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("h1"),
        h.contains("<nav").alias("has_nav"),
        count(r"<a [^>]*href=").alias("links"),
        count(r"<p[ >]").alias("p_open"),
        count(r"</p>").alias("p_close"),
        count(r"<b>").alias("b_open"),
        count(r"</b>").alias("b_close"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """page_id and target of each link."""
    return pages.select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))).alias("target"))


def probe(paths: DataFrame) -> DataFrame:
    """path, its kind by extension, and a key under which names sort naturally, digits as numbers."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(ext.isin("docx", "docm"), "docx").when(ext == "pdf", "pdf").when(ext.isin("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp"), "image").when(ext.isin("md", "txt"), "text").when(ext == "json", "json").otherwise("other")
    pieces = F.regexp_extract_all(F.lower("path"), F.lit(r"(\d+|\D+)"), F.lit(1))
    key = F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 12, "0")).otherwise(x)), "")
    return paths.select("path", kind.alias("kind"), key.alias("natural_key"))


def ignore_list(lines: DataFrame) -> DataFrame:
    """(kind 'id' or 'rule', value) from lines(line) of an ignore file; other lines are skipped."""
    m = r"^\s*-?\s*(id|rule)\s*:\s*['\"]?([^'\"#]+?)['\"]?\s*(#.*)?$"
    return lines.filter(F.col("line").rlike(m)).select(F.regexp_extract("line", m, 1).alias("kind"), F.regexp_extract("line", m, 2).alias("value")).distinct()


def read_ignore(spark: SparkSession, path: str) -> DataFrame:
    return ignore_list(spark.read.text(path).select(F.col("value").alias("line")))


#: Where a specification may lie beside a document, the first that is there counts.
SPEC_NAMES = ("paper-spec.json", "spec.json", ".vellum/spec.json", ".paper/spec.json")


def first_there(spark: SparkSession, paths: Iterable[str | None]) -> str | None:
    """The first of the paths at which a file is, in any file system that Spark knows; null if none is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        if p and (at := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(at):
            return p
    return None


def find_spec(spark: SparkSession, folder: str) -> str | None:
    return first_there(spark, [f"{folder}/{name}" for name in SPEC_NAMES])


def load_spec(spark: SparkSession, path: str | None) -> str | None:
    """The JSON text of a specification; null for no path or no file, which is no error: defaults hold then."""
    if first_there(spark, [path]) is None:
        return None
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def read_spec(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's path) and spec: the whole JSON text of each spec file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("spec"))


def find_anchors(spark: SparkSession, given: str | None = None, configured: str | None = None, folder: str | None = None, default: str | None = None) -> str | None:
    """The anchors file that counts: the one given, else the configured one, the one beside the document, the installed one."""
    return first_there(spark, [given, configured, f"{folder}/.vellum/anchors.yaml" if folder else None, default])


def read_anchors(spark: SparkSession, path: str | None) -> DataFrame:
    """(section, field, tokens) from a YAML file of anchors. It is small: a person wrote it. No path, or no file, gives no rows.

    Sections and fields that aren't a mapping, and empty values, are left out.
    """
    import yaml

    schema = "section string, field string, tokens array<string>"
    if first_there(spark, [path]) is None:
        return spark.createDataFrame([], schema)
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    rows = []
    known = yaml.safe_load(text)
    for section, fields in (known if isinstance(known, dict) else {}).items():
        for field, value in (fields if isinstance(fields, dict) else {}).items():
            tokens = [str(v).strip() for v in (value if isinstance(value, list) else [value]) if v is not None and str(v).strip()]
            if tokens:
                rows.append((section, field, tokens))
    return spark.createDataFrame(rows, schema)


def read_terms(spark: SparkSession, path: str | None) -> DataFrame:
    """(concept, variant) from a YAML file of concepts, each with a list of its variants. It is small: a person wrote it."""
    import yaml

    known = {}
    if first_there(spark, [path]) is not None:
        known = yaml.safe_load("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    rows = [(str(c), str(v).strip()) for c, of in (known if isinstance(known, dict) else {}).items() for v in (of if isinstance(of, list) else [of]) if v is not None and str(v).strip()]
    return spark.createDataFrame(rows, "concept string, variant string")
