"""Readers and writers of the collection's files: gzip JSON lines, TSV, JSON artifacts, Atom XML, whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS = T.StructType([T.StructField(c, T.StringType()) for c in ("docid", "title", "text", "_bad")])


def shards(spark: SparkSession, folder: str, suffix: str = ".jsonl.gz") -> DataFrame:
    """(path, bytes) of the files below `folder` with `suffix`, without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder)
    return found.select("path", F.col("length").alias("bytes"))


def shard_volume(listing: DataFrame) -> DataFrame:
    """(n_shards, bytes) of a listing; -1 and -1 if it is empty."""
    n = F.count(F.lit(1))
    return listing.agg(F.when(n > 0, n).otherwise(-1).alias("n_shards"), F.coalesce(F.sum("bytes"), F.lit(-1)).alias("bytes"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(docid, title, text) of JSON lines, compressed or not; malformed lines are left out, missing fields are empty."""
    lines = spark.read.schema(CORPUS).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return lines.where("_bad is null and docid is not null").select("docid", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text) of TSV lines with at least two columns, trimmed."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where(F.size(parts) >= 2).select(F.trim(parts[0]).alias("qid"), F.trim(parts[1]).alias("text"))


def read_judgments(spark: SparkSession, path: str, queries: DataFrame | None = None) -> DataFrame:
    """(qid, docid, rel) of TSV lines with at least four columns and an integer grade, of `queries` (qid) only if given."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(parts) >= 4).select(F.trim(parts[0]).alias("qid"), F.trim(parts[2]).alias("docid"), F.trim(parts[3]).try_cast("int").alias("rel")).where("rel is not null")
    return rows if queries is None else rows.join(queries, "qid", "left_semi")


def write_corpus(df: DataFrame, path: str) -> None:
    """Gzip JSON lines, sorted by docid."""
    df.select("docid", "title", "text").orderBy("docid").write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "false").json(path)


def _tsv(*columns) -> F.Column:
    return F.concat_ws("\t", *columns)


def write_topics(df: DataFrame, path: str) -> None:
    """TSV of qid and text, sorted by qid."""
    df.orderBy("qid").select(_tsv("qid", "text").alias("value")).write.mode("overwrite").text(path)


def write_judgments(df: DataFrame, path: str) -> None:
    """TSV of qid, 0, docid and grade, sorted by qid and docid."""
    df.orderBy("qid", "docid").select(_tsv("qid", F.lit("0"), "docid", F.col("rel").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_artifact(df: DataFrame, path: str, experiment: str, commit: str) -> None:
    """JSON rows with the experiment, the commit and the time of writing beside them."""
    df.withColumns({"experiment_id": F.lit(experiment), "git_commit": F.lit(commit), "updated_utc": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")}).write.mode("overwrite").json(path)


def read_artifacts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON rows below `path` by one schema for old and new files, fields they lack being null, with `source` as the file."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path).withColumn("source", F.input_file_name())


def read_language_map(spark: SparkSession, path: str, row: str) -> DataFrame:
    """(lang, <row>...) of whole JSON files that are a map from language to a record, or hold one in `languages`; `row` is a DDL struct."""
    text = spark.read.text(path, wholetext=True)
    as_map = lambda s: F.from_json(s, f"map<string, struct<{row}>>")
    inner = F.coalesce(F.get_json_object("value", "$.languages"), F.get_json_object("value", "$.per_language"), F.col("value"))
    return text.select(F.explode(F.map_entries(as_map(inner))).alias("e")).select(F.col("e.key").alias("lang"), "e.value.*")


def language_of(path: F.Column) -> F.Column:
    """The language in a file name such as per_query_yo.json; empty in others."""
    return F.regexp_extract(path, r"per_query_([^./]+)\.json", 1)


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def write_whole_texts(df: DataFrame, folder: str, name: str, text: str) -> int:
    """Each row's `text` as a file of its own below `folder`, named by `name`; how many. A row without name or text is no file.

    A file is put in place under its name when it is whole, so a task that is run again writes the same files.
    """

    def write(source):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        for batch in source:
            for own, value in zip(*(c.to_pylist() for c in batch.columns)):
                passing = f"{root}/.{uuid.uuid4().hex}"
                with files.open_output_stream(passing) as out:
                    out.write(value.encode())
                files.move(passing, f"{root}/{own}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = df.select(F.col(name).alias("name"), F.col(text).alias("text")).where("name is not null and text is not null")
    return rows.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def atom_entries(df: DataFrame, text: str) -> DataFrame:
    """(id, title, published, authors) of the entries of Atom feeds, one feed a row."""
    schema = "entry array<struct<id string, title string, published string, author array<struct<name string>>>>"
    entry = F.explode(F.from_xml(text, schema, {"rowTag": "feed"})["entry"])
    return df.select(entry.alias("e")).select(
        F.regexp_extract("e.id", r"([^/]+?)(v[0-9]+)?$", 1).alias("id"), F.trim(F.regexp_replace("e.title", r"\s+", " ")).alias("title"), "e.published", F.transform("e.author", lambda a: a["name"]).alias("authors")
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` with the rows of `new` in place of those of the same keys. Keys that are null match no row."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)
