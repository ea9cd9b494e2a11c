"""Scalar functions over names made from the tables' keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import refs
from weftline.plans.registry import Plans
from weftline.sources.tables import table

plans = Plans()


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer")


@plans.query("""WITH r AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'stage' || c_nationkey || '.' || c_name WHEN 1 THEN c_name WHEN 2 THEN '/data.d/' || c_name ELSE 'dir.d' || c_name END AS r, c_nationkey AS n FROM customer)
SELECT c_custkey, CAST(CASE WHEN c_custkey % 4 = 0 THEN n ELSE 7 END AS INTEGER) AS stage, CASE WHEN c_custkey % 4 = 0 THEN regexp_replace(r, '^stage[0-9]+\\.', '') ELSE r END AS name, c_custkey % 4 = 0 AS has_index FROM r""")
def fn_parse_producer(spark, sf_dir):
    kind = F.col("c_custkey") % 4
    text = F.when(kind == 0, F.concat(F.lit("stage"), "c_nationkey", F.lit("."), "c_name")).when(kind == 1, F.col("c_name")).when(kind == 2, F.concat(F.lit("/data.d/"), "c_name")).otherwise(F.concat(F.lit("dir.d"), "c_name"))
    return _customers(spark, sf_dir).select("c_custkey", refs.parse_producer(text, F.lit(7)).alias("p")).select("c_custkey", "p.*")


@plans.query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'stage1.sim' WHEN 1 THEN 'sim' WHEN 2 THEN 'data/x/y.csv' WHEN 3 THEN '/abs/dir' END AS producer,
  CASE c_custkey % 5 WHEN 0 THEN 'out/f' || c_custkey WHEN 3 THEN 'f.txt' END AS file, CASE WHEN c_custkey % 5 < 4 THEN 'copy' END AS method FROM customer""")
def fn_parse_dataref(spark, sf_dir):
    kind = F.col("c_custkey") % 5
    text = F.when(kind == 0, F.concat(F.lit("stage1.sim/out/f"), "c_custkey", F.lit(":copy"))).when(kind == 1, "sim:copy").when(kind == 2, "data/x/y.csv:copy").when(kind == 3, "/abs/dir/f.txt:copy").otherwise("a:b:copy")
    return _customers(spark, sf_dir).select("c_custkey", refs.parse_dataref(text).alias("p")).select("c_custkey", "p.producer", "p.file", "p.method")


@plans.query("SELECT c_custkey, 'stage' || c_nationkey || '.' || c_name || CASE WHEN c_custkey % 2 = 0 THEN '/f' ELSE '' END || ':ref' AS reference FROM customer")
def fn_compile_ref(spark, sf_dir):
    file = F.when(F.col("c_custkey") % 2 == 0, "f")
    return _customers(spark, sf_dir).select("c_custkey", refs.compile_ref(F.col("c_nationkey"), F.col("c_name"), file, F.lit("ref")).alias("reference"))


@plans.query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'h2o-' ELSE 'plain' END AS name, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS replica FROM customer")
def fn_split_replica(spark, sf_dir):
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("h2o-"), "c_custkey")).otherwise("plain")
    return _customers(spark, sf_dir).select("c_custkey", refs.split_replica(text).alias("s")).select("c_custkey", "s.*")


@plans.query("SELECT p_partkey, string_split(p_name, ' ')[2] AS word FROM part")
def fn_array_access(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", refs.array_access(F.col("p_name"), 1).alias("word"))


@plans.query("SELECT p_partkey, p_size * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 * 1024 WHEN 2 THEN 1000000000 END::BIGINT AS bytes FROM part")
def fn_memory_bytes(spark, sf_dir):
    unit = F.get(F.array(*[F.lit(x) for x in ("", "Mi", " GB", "parsec")]), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", refs.memory_bytes(F.concat("p_size", unit)).alias("bytes"))


@plans.query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE WHEN 3 THEN FALSE END AS said FROM events")
def fn_str_to_bool(spark, sf_dir):
    text = F.get(F.array(*[F.lit(x) for x in ("Yes", "no", " TRUE", "false", "y")]), (F.col("event_id") % 5).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", refs.to_boolean(text).alias("said"))


@plans.query("SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN c_nationkey END AS stage FROM customer")
def fn_stage_index(spark, sf_dir):
    kind = F.col("c_custkey") % 3
    text = F.when(kind == 0, F.concat(F.lit("stage"), "c_nationkey")).when(kind == 1, F.col("c_nationkey").cast("string")).otherwise("stageX")
    return _customers(spark, sf_dir).select("c_custkey", refs.stage_index(text).alias("stage"))


@plans.query("SELECT s_suppkey, 'file' AS scheme, 'gw' || s_nationkey AS gateway, '/runs/' || s_name AS path FROM supplier")
def fn_uri_partition(spark, sf_dir):
    uri = F.concat(F.lit("file://gw"), "s_nationkey", F.lit("/runs/"), "s_name")
    return table(spark, sf_dir, "supplier").select("s_suppkey", refs.uri_parts(uri).alias("u")).select("s_suppkey", "u.*")


@plans.query("SELECT s_suppkey, 'b' || s_nationkey AS bucket, 'runs/' || s_name AS key FROM supplier")
def fn_s3_uri(spark, sf_dir):
    uri = F.concat(F.lit("s3://b"), "s_nationkey", F.lit("/runs/"), "s_name")
    return table(spark, sf_dir, "supplier").select("s_suppkey", refs.s3_parts(uri).alias("u")).select("s_suppkey", "u.*")


@plans.query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'quay.example:5000' WHEN 1 THEN 'localhost' END AS registry,
  CASE s_suppkey % 3 WHEN 2 THEN 'tool' ELSE 'org/tool' END AS name, CASE s_suppkey % 3 WHEN 1 THEN 'latest' ELSE 'v' || s_suppkey END AS tag FROM supplier""")
def fn_image_parts(spark, sf_dir):
    kind = F.col("s_suppkey") % 3
    tag = F.concat(F.lit(":v"), "s_suppkey")
    image = F.when(kind == 0, F.concat(F.lit("quay.example:5000/org/tool"), tag)).when(kind == 1, "localhost/org/tool").otherwise(F.concat(F.lit("tool"), tag))
    return table(spark, sf_dir, "supplier").select("s_suppkey", refs.image_parts(image).alias("i")).select("s_suppkey", "i.*")


@plans.query("""SELECT s_suppkey, '/a/b:c/f' || s_suppkey AS source, CASE WHEN s_suppkey % 2 = 0 THEN 't' || s_suppkey ELSE 'f' || s_suppkey END AS target FROM supplier""")
def fn_path_rename(spark, sf_dir):
    text = F.concat(F.lit("/a/b\\:c/f"), "s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(":t"), "s_suppkey")).otherwise(""))
    return table(spark, sf_dir, "supplier").select("s_suppkey", refs.path_rename(text).alias("r")).select("s_suppkey", "r.*")


@plans.query("SELECT s_suppkey, '100%25 of ' || s_name || ' %26 more' AS uid FROM supplier")
def fn_uid_escape(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", refs.uid_escape(F.concat(F.lit("100% of "), "s_name", F.lit(" & more"))).alias("uid"))


@plans.query("SELECT p_partkey, 'size,brand' AS names FROM part")
def fn_var_refs(spark, sf_dir):
    text = F.concat(F.lit("run %(size)s on %(brand)s with %(size)s, "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(refs.variables_in(text), ",").alias("names"))


@plans.query("SELECT event_id, epoch_us(ts) / 1e6 AS seconds FROM events")
def fn_total_seconds(spark, sf_dir):
    from weftline.operators.history import seconds_between

    return table(spark, sf_dir, "events").select("event_id", seconds_between(F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")).alias("seconds"))


@plans.query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H%M%S.%f') AS stamp FROM events")
def fn_epoch_to_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T"), F.date_format("ts", "HHmmss.SSSSSS")).alias("stamp"))


@plans.query("SELECT c_custkey, 'a=1,b=' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '2' END || ',c=' || c_nationkey AS vars FROM customer")
def fn_map_override(spark, sf_dir):
    one = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"), F.lit("d"), F.lit(""))
    two = F.create_map(F.lit("b"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), F.lit("c"), F.col("c_nationkey").cast("string"))
    entries = F.sort_array(F.map_entries(refs.without_empty(refs.overridden(one, two))))
    return _customers(spark, sf_dir).select("c_custkey", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("vars"))
