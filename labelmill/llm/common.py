"""Small pieces shared by the operators: scratch tables, text as words, stable fractions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ALNUM = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in _LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees. Where it is unset a local session (tests) gets one of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="labelmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/labelmill/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Workers get at most 1,000 rows of text, or 8 MB, at a time, as whole texts may be long; a session that has set its own limits keeps them."""
    of = "spark.sql.execution.arrow."
    if spark.conf.get(f"{of}maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set(f"{of}maxRecordsPerBatch", "1000")
    if spark.conf.get(f"{of}maxBytesPerBatch", None) in (None, "64MB", str(64 << 20)):
        spark.conf.set(f"{of}maxBytesPerBatch", str(8 << 20))


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df in the shared folder and read it again: lineage ends in files that survive a lost executor."""
    small_batches(df.sparkSession)
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, row: str, stored: bool = False) -> DataFrame:
    """docs with a number of each row as `row`, the same however often it is read.

    docs is written with its numbers. If it is stored, that is, a Parquet table as read and nothing more, its rows are told
    by file and place instead, and nothing is written but the list of files; any other frame is written all the same.
    """
    if stored:
        path, at = free_name(docs, "path"), free_name(docs, "at")
        try:
            told = docs.metadataColumn("_metadata")
            placed = docs.withColumns({path: told["file_path"], at: told["row_index"]})
        except AnalysisException:  # no table of files
            placed = None
        if placed is not None:
            rows, places = placed.select(F.count("*"), F.count_distinct(path, at)).first()
            if rows == places:
                files = cut(placed.select(path).distinct().withColumn(row, F.row_number().over(Window.orderBy(path)).cast("long")), "files")  # a row for each file
                return placed.join(F.broadcast(files), path).select(*docs.columns, F.shiftleft(row, 36).bitwiseOR(F.col(at)).alias(row))
    return cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")


def words_lower(text: str | None) -> list[bytes]:
    """Lower-cases A-Z; words between ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def words_alnum(text: str | None) -> list[bytes]:
    """Lower-cases A-Z; words of digits, a-z and anything beyond ASCII, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_ALNUM).split()


def n_words(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fraction(*cols: Column | str, seed: str = "") -> Column:
    """A number in [0, 1) that depends on nothing but the values and the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols]), F.lit(1 << 40)) / float(1 << 40)


def usable(vector) -> Column:
    """Neither null nor holding a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
