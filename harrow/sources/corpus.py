"""Reading and writing corpora and evaluation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SourceError

DOCUMENT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "title", "text", "source_uri")] + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
QUERY_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("query_id", "query")] + [T.StructField("relevant_doc_ids", T.ArrayType(T.StringType()))] + [T.StructField(c, T.StringType()) for c in ("source", "topic")]
)
REQUIRED = ("doc_id", "title", "text", "source_uri")


def _status(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(hadoop) if fs.exists(hadoop) else None


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """A ``.jsonl`` file or a folder of ``.md`` and ``.txt`` files, as (doc_id, title, text, source_uri, metadata)."""
    status = _status(spark, path)
    if status is None:
        raise SourceError(f"no corpus at {path}")
    if status.isFile() and path.endswith(".jsonl"):
        return read_jsonl(spark, path)
    if status.isDirectory():
        return read_text_folder(spark, path)
    raise SourceError(f"{path} is neither a .jsonl file nor a folder")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line, blank lines skipped. A malformed record fails the read and is shown.

    The four fields are required and may be any scalar; ``metadata`` may be left out but must be an object if given.
    """
    raw = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    parsed = raw.withColumn("v", F.try_parse_json("value"))
    string = lambda c: F.try_variant_get("v", f"$.{c}", "string")
    kind = F.schema_of_variant(F.try_variant_get("v", "$.metadata", "variant"))
    missing = F.coalesce(F.expr(" or ".join(f"variant_get(v, '$.{c}', 'variant') is null" for c in REQUIRED)), F.lit(True))
    bad = F.col("v").isNull() | missing | (kind.isNotNull() & ~kind.startswith("OBJECT"))
    shown = F.concat(F.col("file"), F.lit(": malformed record: "), F.substring("value", 1, 120))
    checked = parsed.withColumn("ok", F.when(bad, F.raise_error(shown)).otherwise(F.lit(True))).where("ok")
    metadata = F.coalesce(F.from_json(F.to_json(F.try_variant_get("v", "$.metadata", "variant")), "map<string,string>"), F.create_map().cast("map<string,string>"))
    return checked.select(*[string(c).alias(c) for c in REQUIRED], metadata.alias("metadata"))


def read_text_folder(spark: SparkSession, path: str) -> DataFrame:
    """Every ``.md`` and ``.txt`` below ``path``; the title is the first heading that starts a line, else the file's name."""
    root = _status(spark, path).getPath().toString().rstrip("/") + "/"
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").text(path, wholetext=True)
    rows = files.select(F.col("value").alias("text"), F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))").alias("full"), F.col("_metadata.file_path").alias("source_uri"))
    relative = F.regexp_replace("full", "^.*?" + _quoted(root.split(":", 1)[-1].lstrip("/")), "")
    heading = r"(?m)^(?:(={2,6})\s*(.+?)\s*\1|#{1,6}\s+(.+?))\s*$"
    title = F.coalesce(F.nullif(F.regexp_extract("text", heading, 2), F.lit("")), F.nullif(F.regexp_extract("text", heading, 3), F.lit("")), F.regexp_extract("full", r"([^/]*)\.[^./]*$", 1))
    return rows.select(F.concat(F.lit("file:"), relative).alias("doc_id"), title.alias("title"), "text", "source_uri", F.create_map(F.lit("source"), F.lit("file")).alias("metadata"))


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, relevant_doc_ids, source, topic); blank lines are skipped, malformed ones fail the read."""
    if _status(spark, path) is None:
        raise SourceError(f"no query file at {path}; build the evaluation set first")
    return spark.read.schema(QUERY_SCHEMA).option("mode", "FAILFAST").json(path)


def write_jsonl(rows: DataFrame, path: str, order: str | None = None) -> None:
    """JSON lines in a folder; with ``order`` the files, by name, and the lines in them are in ascending order of it."""
    if order:
        rows = rows.repartitionByRange(order).sortWithinPartitions(order)
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def first_by_id(rows: DataFrame, order: str, id_col: str = "doc_id") -> DataFrame:
    """The first row of each id, in ``order``."""
    w = Window.partitionBy(id_col).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def build_corpus(articles: DataFrame, papers: DataFrame, mirrors: DataFrame | None = None) -> DataFrame:
    """Articles, papers and mirrors in this order, the first of each id."""
    parts = [d.withColumn("_seq", F.concat_ws(":", F.lit(str(i)), F.col("doc_id").cast("string"))) for i, d in enumerate([articles, papers, *([mirrors] if mirrors is not None else [])])]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return first_by_id(rows, "_seq").drop("_seq")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a saved Atom feed (id, title, summary, published, primary_category)."""
    schema = "id string, title string, summary string, published string, `arxiv:primary_category` struct<_term:string>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    return rows.select("id", "title", "summary", "published", F.col("`arxiv:primary_category`._term").alias("primary_category"))
