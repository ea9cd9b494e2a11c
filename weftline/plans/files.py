"""Sources and sinks: tables written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.plans.registry import Plans
from weftline.session import shared_dir
from weftline.sources import delimited, files, sinks
from weftline.sources.tables import table

plans = Plans()


def _place(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@plans.query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def src_csv_file(spark, sf_dir):
    place = _place(spark, "csv")
    delimited.write_delimited(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), place, ";")
    return delimited.read_delimited(spark, place)


@plans.query("SELECT p_partkey AS id, p_name AS name, p_size::DOUBLE / 2 AS half FROM part")
def src_csv_string(spark, sf_dir):
    place = _place(spark, "text")
    lines = table(spark, sf_dir, "part").select(F.concat_ws(" , ", "p_partkey", "p_name", F.col("p_size") / 2).alias("value"))
    head = spark.createDataFrame([("# made by hand\nid, name ,half,\n# first rows",)], "value string")
    head.coalesce(1).unionByName(lines).coalesce(1).write.text(place)  # a file with one head
    return delimited.read_delimited(spark, place)


@plans.query("SELECT n_nationkey || ', ' || n_name || ', ' || n_regionkey AS line FROM nation")
def snk_csv_string(spark, sf_dir):
    return delimited.csv_lines(table(spark, sf_dir, "nation"))


@plans.query("SELECT n_regionkey AS region, CAST(count(*) AS BIGINT) AS n_rows FROM nation GROUP BY 1")
def src_csv_many(spark, sf_dir):
    place = _place(spark, "many")
    nations = table(spark, sf_dir, "nation").withColumn("region", F.col("n_regionkey"))
    nations.write.partitionBy("region").option("header", True).csv(place)
    read = delimited.read_delimited(spark, f"{place}/region=*", tag_files=True)
    region = F.regexp_extract("file", "region=([0-9]+)", 1).cast("int")
    return read.groupBy(region.alias("region")).agg(F.count(F.lit(1)).alias("n_rows"))


@plans.query("SELECT 5 AS n_files, TRUE AS filled")
def src_dir_search(spark, sf_dir):
    place = _place(spark, "search")
    table(spark, sf_dir, "region").repartitionByRange(1, "r_regionkey").write.partitionBy("r_regionkey").json(place)
    found = files.listing(spark, place, "*.json")
    return found.agg(F.count(F.lit(1)).cast("int").alias("n_files"), F.bool_and(F.col("length") > 0).alias("filled"))


@plans.query("SELECT 'running' AS state, 'a=b' AS reason, CAST(count(*) AS VARCHAR) AS n FROM orders")
def src_status_file(spark, sf_dir):
    place = _place(spark, "status")
    n = table(spark, sf_dir, "orders").agg(F.concat(F.lit("state = running\nreason=a=b\nn="), F.count(F.lit(1))).alias("value"))
    n.coalesce(1).write.text(place)
    status = files.status_entries(spark, place).where(F.size("status") > 0)
    return status.select(F.btrim(F.col("status")["state"]).alias("state"), F.col("status")["reason"].alias("reason"), F.col("status")["n"].alias("n"))


@plans.query("SELECT user_id AS reference, event_id AS seq, date_trunc('second', ts) AS launch_ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS run_s,"
             " CAST(CASE WHEN event_type IN ('error', 'view') THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM events")
def src_execution_history(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("reference"), F.col("event_id").alias("seq"), F.date_format("ts", "ddMMyy-HHmmss").alias("component-launch-time"),
        F.when(F.col("event_id") % 7 == 0, "N/A").otherwise(F.col("value").cast("string")).alias("task-run-time"),
        F.when(F.col("event_type") == "view", "None").when(F.col("event_type") == "error", "1").otherwise("0").alias("exit-code"),
    )
    return files.normalised_history(raw)


@plans.query("SELECT CAST(500 AS BIGINT) AS n, CAST(20 AS BIGINT) AS n_components, TRUE AS in_range, TRUE AS some_fail")
def src_simulated(spark, sf_dir):
    made = files.simulated(spark, 20, 25)
    return made.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("reference").alias("n_components"),
        F.bool_and(F.col("run_s").between(0, 60)).alias("in_range"), F.bool_or(F.col("exit_code") == 1).alias("some_fail"),
    )


@plans.query("SELECT o_orderstatus AS name, CAST(count(*) AS BIGINT) AS version FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderstatus <> 'P' GROUP BY 1")
def snk_key_outputs(spark, sf_dir):
    place = _place(spark, "outputs")
    counted = F.count_if((F.col("o_orderkey") % 5 != 0) & (F.col("o_orderstatus") != "P"))
    sinks.key_outputs(table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(counted.alias("version")), place)
    return spark.read.schema("name string, version bigint").json(place)


@plans.query("SELECT user_id AS reference, arg_max(event_id, (ts, event_id)) AS seq FROM events GROUP BY 1")
def snk_upsert_sqlite(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("reference"), "ts", F.col("event_id").alias("seq"))
    return sinks.latest_by_key(rows, "reference", ["ts", "seq"]).select("reference", "seq")


@plans.query("SELECT event_id AS seq, value AS run_s FROM events")
def snk_perf_append(spark, sf_dir):
    place = _place(spark, "launches")
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("value").alias("run_s"))
    for part in (runs.where("seq % 2 = 0"), runs.where("seq % 2 = 1")):
        sinks.append_launches(part, place)
    return spark.read.parquet(place)


@plans.query("""SELECT n_regionkey AS stage, '[' || string_agg('{"stage":' || n_regionkey || ',"name":"' || n_name || '"}', ',' ORDER BY n_name) || ']' AS details FROM nation GROUP BY 1""")
def snk_status_details(spark, sf_dir):
    return sinks.status_details(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("stage"), F.col("n_name").alias("name")))
