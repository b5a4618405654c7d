"""Sources: trees of files, JSON knowledge bases, requirement texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text

_IDS = ("node_id", "id", "function_name", "name")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of source files below ``root``: known suffixes only, nothing below an ignored directory.

    Suffixes and directories are tested on the path before the content is read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").rpartition("/")[2]
    path = F.regexp_replace("path", r"^.*?/(?=" + base.replace(".", r"\.") + r"/)", "")
    rows = raw.withColumn("path", path).where(text.detect_language(F.col("path")).isNotNull() & ~text.in_ignored_dir(F.col("path")))
    return rows.select("path", "content")


def read_requirements(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one requirement a .txt file, named by the file."""
    raw = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("doc_id"), F.col("value").alias("text"))


def _records(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """Rows of a document that is an array of objects, or an object that holds one under one of ``keys``."""
    df = spark.read.option("multiLine", "true").json(path)
    for key in keys:
        if key in df.columns:
            return df.select(F.explode(key).alias("r")).select("r.*")
    return df


def _first(df: DataFrame, names: tuple[str, ...], default: str | None = None):
    got = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*got, F.lit(default)) if got else F.lit(default).cast("string")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(id, clean, summary, file_path, signature, language[, vector]); records without any id are left out."""
    df = _records(spark, path, ("vectors", "Vectors"))
    vector = [F.col("embedding").cast("array<float>").alias("vector")] if "embedding" in df.columns else [F.lit(None).cast("array<float>").alias("vector")]
    rows = df.select(
        _first(df, _IDS).alias("id"), _first(df, ("summary", "docstring"), "").alias("summary"), _first(df, ("file_path", "path"), "Unknown").alias("file_path"),
        _first(df, ("signature",), "").alias("signature"), _first(df, ("language",), "unknown").alias("language"), *vector,
    ).where("id is not null")
    return rows.withColumn("clean", text.clean_func_id(F.col("id")))


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """(edge_id, source_id, target_id, type) in the order of the document; null and empty ends are left out."""
    df = _records(spark, path, ("edges",))
    rows = df.select("source_id", "target_id", "type").where("source_id <> '' and target_id <> ''")
    return rows.withColumn("edge_id", F.monotonically_increasing_id())


def there(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_knowledge(spark: SparkSession, folder: str, graph: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(metadata, edges) of a folder: the tables of a build, with its vectors if it has some, or documents of JSON.

    Of documents ``knowledge_graph.json`` goes before ``edges.json``, and ``graph`` names another one.
    """
    folder = folder.rstrip("/")
    if there(spark, f"{folder}/metadata"):
        rows = spark.read.parquet(f"{folder}/metadata").drop("embedding")
        if there(spark, f"{folder}/vectors"):
            rows = rows.join(spark.read.parquet(f"{folder}/vectors").select("id", F.col("embedding").alias("vector")), "id", "left")
        else:
            rows = rows.withColumn("vector", F.lit(None).cast("array<float>"))
        edges = spark.read.parquet(f"{folder}/edges").select("source_id", "target_id", "type").where("source_id <> '' and target_id <> ''")
        return rows.withColumn("clean", text.clean_func_id(F.col("id"))), edges.sort("source_id", "target_id", "type").withColumn("edge_id", F.monotonically_increasing_id())
    named = [graph] if graph else [f"{folder}/knowledge_graph.json", f"{folder}/edges.json"]
    return read_metadata(spark, f"{folder}/metadata.json"), read_graph(spark, next((x for x in named if there(spark, x)), named[-1]))
