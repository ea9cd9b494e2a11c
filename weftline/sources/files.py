"""Folders, status files, execution histories and made-up launches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """``path, modificationTime, length`` of files whose name matches a glob; contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    found = reader.load(folder).select("path", "modificationTime", "length")
    if since is not None:
        found = found.where(F.col("modificationTime") >= since)
    return found if until is None else found.where(F.col("modificationTime") < until)


def older_than(files: DataFrame, seconds: int, now: Column) -> DataFrame:
    """Files that nobody has written to for a while."""
    return files.where(F.col("modificationTime") < now - F.make_dt_interval(secs=F.lit(seconds)))


def contents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, content, digest``: whole files and their md5."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content", F.md5("content").alias("digest"))


def status_entries(spark: SparkSession, path: str) -> DataFrame:
    """``path, status``: the map of each file of ``key=value`` lines; escaped line ends are restored."""
    lines = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    pairs = F.filter(F.split("value", "\n"), lambda x: F.contains(x, F.lit("=")))
    one = lambda x: F.struct(F.btrim(F.split_part(x, F.lit("="), F.lit(1))).alias("k"), F.replace(F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1), F.lit("\\n"), F.lit("\n")).alias("v"))
    return lines.select("path", F.map_from_entries(F.transform(pairs, one)).alias("status"))


def normalised_history(raw: DataFrame, reference: str = "reference") -> DataFrame:
    """``reference, seq, launch_ts, run_s, exit_code`` from a performance file's columns.

    Launch times are ``ddMMyy-HHmmss``; run times are seconds, ``N/A`` is NULL; a missing
    exit code or the text ``None`` counts as 1.
    """
    code = F.when(F.lower("exit-code") == "none", None).otherwise(F.col("exit-code").cast("string")).try_cast("int")
    launch = F.try_to_timestamp(F.col("component-launch-time"), F.lit("ddMMyy-HHmmss")).cast("timestamp_ntz")
    return raw.select(
        F.col(reference).alias("reference"), "seq", launch.alias("launch_ts"),
        F.col("task-run-time").cast("string").try_cast("double").alias("run_s"), F.coalesce(code, F.lit(1)).alias("exit_code"),
    )


def simulated(spark: SparkSession, components: int, launches: int, seed: int = 0, longest_s: float = 60.0, fail_share: float = 0.2) -> DataFrame:
    """``executions`` drawn from hashes, the same for the same seed: run after run, with idle time between."""
    rows = spark.range(components * launches)
    reference, seq = (F.col("id") / launches).cast("long"), F.col("id") % launches
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(1_000_000)) / F.lit(1e6)
    start = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(seq * F.lit(2 * longest_s) + draw(1) * longest_s).cast("decimal(18,6)"))
    return rows.select(
        reference.alias("reference"), F.col("id").alias("seq"), start.alias("launch_ts"), (draw(2) * longest_s).alias("run_s"),
        F.when(draw(3) < fail_share, 1).otherwise(0).alias("exit_code"),
    )
