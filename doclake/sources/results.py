"""Result tables, CSV files and the content list of a download bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclake import constants as C
from doclake.operators.extract import csv_tables
from doclake.operators.jobs import list_jobs
from doclake.operators.skew import running_total
from doclake.sources import keyed
from doclake.sources.scratch import freeze
from doclake.sources.uploads import many_tasks, scan_uploads

BYTE_ORDER_MARK = "\ufeff"
PACK_BYTES = 64 << 20


def write_results(results: DataFrame, path: str) -> None:
    """Store ``(sha256, opts_hash, text, n_tables, n_images)``, one row per key, in a new directory.

    Of several conversions of one key one stays, that with the largest counts; their texts are equal.
    """
    key = ["sha256", "opts_hash"]
    best = F.max_by("text", F.struct("n_tables", "n_images")).alias("text")
    counts = F.max(F.struct("n_tables", "n_images")).alias("r")
    results.groupBy(*key).agg(best, counts).select(*key, "text", "r.*").write.parquet(path)


def upsert_results(results: DataFrame, path: str, newest: list[str], buckets: int = keyed.BUCKETS) -> None:
    """Put results (with ``sha256, opts_hash``) into the keyed table at ``path``; see ``keyed.upsert``."""
    keyed.upsert(results, path, ["sha256", "opts_hash"], newest, buckets)


def write_packed_csv(docs: DataFrame, path: str, key: str = "doc_id", col: str = "text", pack_bytes: int = PACK_BYTES) -> None:
    """Write the tables of all documents as CSV into few large text files, with an index.

    ``path/packs/pack=<n>`` holds one file of about ``pack_bytes`` (a single larger table stays whole), the tables
    one after another in order of document and number, each in UTF-8 with a byte order mark and a newline at its
    end. ``path/index`` holds ``key, table_no, pack, offset, length`` in bytes, without that newline. Documents
    need distinct keys.
    """
    tables = csv_tables(docs, key, col).withColumn("csv", F.concat(F.lit(BYTE_ORDER_MARK), "csv"))
    sizes = tables.select(key, "table_no", F.octet_length("csv").cast("bigint").alias("length"))
    placed = running_total(sizes, [], [F.col(key), F.col("table_no")], F.col("length") + 1, "_start")
    placed = placed.withColumn("pack", F.floor(F.col("_start") / pack_bytes))
    # a pack is bounded in bytes, so its first table is found in one task
    first = F.min("_start").over(Window.partitionBy("pack"))
    index = freeze(placed.select(key, "table_no", "pack", (F.col("_start") - first).alias("offset"), "length"), "index")
    (tables.join(index, [key, "table_no"]).repartition("pack").sortWithinPartitions("pack", "offset")
     .select("pack", F.col("csv").alias("value")).write.option("lineSep", "\n").partitionBy("pack").text(f"{path}/packs"))
    index.write.parquet(f"{path}/index")


def read_packed_csv(spark: SparkSession, path: str, wanted: Column | None = None, key: str = "doc_id") -> DataFrame:
    """``key, table_no, csv`` of all tables, or of those whose index row is ``wanted``; only their packs are opened."""
    index = spark.read.parquet(f"{path}/index")
    index = index if wanted is None else index.filter(wanted)
    per_pack = index.groupBy("pack").agg(F.collect_list(F.struct(key, "table_no", "offset", "length")).alias("t"))
    packs = spark.read.format("binaryFile").load(f"{path}/packs").select("content", F.col("pack").cast("bigint"))
    cut = lambda t: F.struct(
        t[key].alias(key), t["table_no"].alias("table_no"), F.decode(F.substring(
            F.col("content"), (t["offset"] + 1).cast("int"), t["length"].cast("int")), "utf-8").alias("csv"))
    return packs.join(per_pack, "pack").select(F.explode(F.transform("t", cut)).alias("t")).select("t.*")


def write_table_csv(docs: DataFrame, path: str, key: str = "doc_id", col: str = "text") -> None:
    """Write each table of each document as ``<key>/table=table-NN/*.csv`` in UTF-8 with a byte order mark.

    A table is one row until it is written, so each table becomes one file. Making a file takes longer than making
    what is in it, so tables are spread over tasks by their document, however the documents were split.
    """
    (csv_tables(docs, key, col)
     .select(key, F.format_string("table-%02d", "table_no").alias("table"),
             F.concat(F.lit(BYTE_ORDER_MARK), "csv").alias("value"))
     .repartition(many_tasks(docs.sparkSession), key).write.option("lineSep", "\n").partitionBy(key, "table").text(path))


def read_table_csv(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``key, table, csv`` of all files that ``write_table_csv`` made; a task opens many of them, as they are small."""
    files = scan_uploads(spark, path, columns=[key, "table"]).coalesce(many_tasks(spark))
    return files.select(key, "table", F.decode("content", "utf-8").alias("csv"))


def base_name(filename: Column) -> Column:
    """File name without folders and extension, safe as a folder name."""
    name = F.regexp_replace(filename, r"(?:/\.?)++\z", "")
    name = F.regexp_extract(F.when(name == ".", "").otherwise(name), r"([^/]*)\z", 1)
    stem = F.regexp_replace(name, r"(?s)\A(.+)\.[^.]+\z", "$1")
    safe = F.regexp_replace(stem, C.UNSAFE_IN_NAMES, "_")
    safe = F.regexp_replace(safe, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    return F.when(safe.rlike(r"\A\.*\z"), "file").otherwise(safe)


def safe_names(df: DataFrame, order: list[Column], col: str = "filename") -> DataFrame:
    """Add ``folder``: the base name, with ``-1``, ``-2``, … for repeats in ``order``."""
    named = running_total(df.withColumn("_base", base_name(F.col(col))), ["_base"], order, F.lit(1), "_repeat")
    return named.withColumn(
        "folder", F.when(F.col("_repeat") == 0, F.col("_base"))
        .otherwise(F.concat("_base", F.lit("-"), F.col("_repeat").cast("string")))).drop("_base", "_repeat")


def bundle_manifest(jobs: DataFrame, files: DataFrame, session: str | None = None, admin: bool = False,
                    limit: int | None = None) -> DataFrame:
    """Entries of the "download all" bundle from ``files(result_dir, rel_path)``, for the newest ``limit`` jobs or all.

    Jobs whose directory is gone do not use up a suffix.
    """
    done = (list_jobs(jobs, session, admin, limit)
            .filter((F.col("status") == "done") & (F.col("result_dir") != ""))
            .select("id", "filename", "result_dir", "created_at"))
    ours = files.join(done.select("result_dir").distinct(), "result_dir", "left_semi")
    present = done.join(ours.select("result_dir").distinct(), "result_dir", "left_semi")
    named = safe_names(newest_first(present), [F.col("_rank")])
    return (ours.join(named.select("id", "result_dir", "folder"), "result_dir")
            .select("id", "folder", "rel_path", F.concat("folder", F.lit("/"), "rel_path").alias("entry")))


def newest_first(jobs: DataFrame) -> DataFrame:
    """Add ``_rank``: the place of a job, newest first and larger id first, as one ascending number."""
    fewer = running_total(jobs, [], [F.col("created_at"), F.col("id")], F.lit(1), "_rank")
    return fewer.withColumn("_rank", -F.col("_rank"))
