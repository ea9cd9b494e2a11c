"""Document and property queries: orders as documents, their lines' flags and parts as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import documents as ops
from weftline.operators import properties
from weftline.plans.registry import Plans
from weftline.sources.tables import table

plans = Plans()

_DOCS = """
docs AS (SELECT o_orderkey AS doc_id, 'file://gateway' || (o_custkey % 3) || '/runs/o' || o_orderkey AS instance,
  'job' || (o_custkey % 7) AS name, CAST(o_custkey % 4 AS INTEGER) AS stage, o_orderstatus AS type FROM orders)"""
_FILES = """
files AS (SELECT l_orderkey AS doc_id, 'file://gateway' || (l_suppkey % 3) || '/runs/o' || l_orderkey || '/' || l_returnflag || l_linenumber
  || CASE WHEN l_linestatus = 'F' THEN '.csv' ELSE '.txt' END AS file FROM lineitem)"""


def docs(spark, sf_dir):
    custkey = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.lit("file://gateway"), custkey % 3, F.lit("/runs/o"), F.col("o_orderkey")).alias("instance"),
        F.concat(F.lit("job"), custkey % 7).alias("name"), (custkey % 4).cast("int").alias("stage"), F.col("o_orderstatus").alias("type"),
    )


def files(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.concat(
            F.lit("file://gateway"), F.col("l_suppkey") % 3, F.lit("/runs/o"), F.col("l_orderkey"), F.lit("/"), "l_returnflag", "l_linenumber",
            F.when(F.col("l_linestatus") == "F", ".csv").otherwise(".txt"),
        ).alias("file"),
    )


def filed_docs(spark, sf_dir):
    gathered = files(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("file").alias("files"))
    return docs(spark, sf_dir).join(gathered, "doc_id")


@plans.query(f"WITH {_DOCS} SELECT * FROM docs WHERE regexp_matches(instance, '.*/runs/o1') AND regexp_matches(name, 'job3') AND stage = 2 AND regexp_matches(type, 'O')")
def flt_doc_query(spark, sf_dir):
    return docs(spark, sf_dir).where(ops.doc_query({"type": "P"}, instance="/runs/o1", name="stage2.job3", type="O"))


@plans.query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'ring|bol')")
def flt_doc_regex(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").where(ops.matches({"p_name": "ring|bol"}))


@plans.query("SELECT p_partkey, p_name, p_size FROM part WHERE regexp_matches(p_name, '^(?:red|blue b)') AND p_size = 28")
def flt_doc_tiny(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").where(ops.matches({"p_name": "red|blue b", "p_size": 28}, anchored=True))


@plans.query("SELECT event_id FROM events WHERE regexp_matches(event_type, 'e.r') AND CAST(json_extract_string(props, '$.k') AS BIGINT) = 69")
def flt_doc_nested(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k bigint").alias("props"))
    return parsed.where(ops.matches({"event_type": "e.r", "props": {"k": 69}})).select("event_id")


@plans.query("SELECT l_orderkey AS doc_id, CAST(count(*) AS BIGINT) AS n_files FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R' AND l_linenumber = 7)")
def flt_doc_elem_match(spark, sf_dir):
    found = filed_docs(spark, sf_dir).where(ops.elem_match("files", "/R7"))
    return found.select("doc_id", F.size("files").cast("long").alias("n_files"))


@plans.query(f"WITH {_DOCS} SELECT doc_id FROM docs WHERE regexp_matches(instance, '.*runs/o77') UNION ALL SELECT doc_id FROM docs WHERE regexp_matches(instance, 'file://gateway1/runs/o99')")
def flt_uri_prefix(spark, sf_dir):
    found = [docs(spark, sf_dir).where(ops.doc_query(instance=i)).select("doc_id") for i in ("runs/o77", "file://gateway1/runs/o99")]
    return found[0].union(found[1])


@plans.query(f"WITH {_FILES} SELECT doc_id, file FROM files JOIN (SELECT o_orderkey FROM orders) ON o_orderkey = doc_id WHERE regexp_matches(file, '^(?:.*runs/o[0-9]+/A[12]\\.csv)')")
def flt_files_in_docs(spark, sf_dir):
    return ops.files_of(filed_docs(spark, sf_dir), r"runs/o[0-9]+/A[12]\.csv")


@plans.query(f"WITH {_FILES} SELECT doc_id, file FROM files WHERE file LIKE '%.csv' AND regexp_matches(regexp_extract(file, '([^/]*)$', 1), '^(?:R[1-3])')")
def flt_files_dataframe(spark, sf_dir):
    return ops.tables_of(files(spark, sf_dir), "R[1-3]")


@plans.query(f"WITH {_DOCS} SELECT EXISTS (SELECT 1 FROM docs WHERE regexp_matches(name, 'job6')) AS found")
def flt_exists(spark, sf_dir):
    return docs(spark, sf_dir).agg(F.coalesce(F.bool_or(ops.matches({"name": "job6"})), F.lit(False)).alias("found"))


@plans.query("SELECT DISTINCT user_id, event_type FROM events WHERE value > 20")
def agg_distinct_values(spark, sf_dir):
    return ops.distinct_values(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.col("value") > 20)


@plans.query(f"""WITH {_FILES} SELECT regexp_extract(file, '^file://([^/]*)', 1) AS gateway, regexp_extract(file, '^file://[^/]*(.*)/[^/]*$', 1) AS instance,
  string_agg(file, ' ' ORDER BY file) AS files FROM files GROUP BY 1, 2""")
def agg_group_files(spark, sf_dir):
    found = ops.file_groups(files(spark, sf_dir).withColumnRenamed("file", "uri"))
    return found.withColumn("files", F.array_join("files", " "))


@plans.query(f"""WITH {_DOCS}, new AS (SELECT doc_id, instance, 'redone' AS name, stage, type FROM docs WHERE type = 'F' AND stage = 1)
SELECT * FROM docs WHERE instance NOT IN (SELECT instance FROM new) UNION ALL SELECT * FROM new""")
def snk_upsert_docs(spark, sf_dir):
    old = docs(spark, sf_dir)
    return ops.upserted(old, old.where("type = 'F' AND stage = 1").withColumn("name", F.lit("redone")), ["instance"])


@plans.query(f"""WITH {_DOCS}, old AS (SELECT * FROM docs WHERE stage < 2), new AS (SELECT * FROM docs WHERE type = 'F')
SELECT * FROM old UNION ALL SELECT * FROM new WHERE instance NOT IN (SELECT instance FROM old)""")
def snk_insert_if_absent(spark, sf_dir):
    every = docs(spark, sf_dir)
    return ops.inserted_if_absent(every.where("stage < 2"), every.where("type = 'F'"), ["instance"])


@plans.query("""SELECT c_custkey AS instance, CASE WHEN o.o_custkey IS NULL THEN 'segment=' || c_mktsegment
  ELSE 'orders=' || n || ',segment=ordering' END AS tags
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def snk_tag_propagate(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("instance"), F.create_map(F.lit("segment"), "c_mktsegment").alias("tags"))
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    new = counts.select(F.col("o_custkey").alias("instance"), F.create_map(F.lit("orders"), F.col("n").cast("string"), F.lit("segment"), F.lit("ordering")).alias("tags"))
    merged = ops.tagged(own, new)
    text = F.transform(F.sort_array(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return merged.select("instance", F.array_join(text, ",").alias("tags"))


@plans.query("""SELECT c_custkey AS reference, coalesce(state, 'unknown') AS state, coalesce(memo_hash, 'missing') AS memo_hash FROM customer
LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS state FROM orders GROUP BY 1) ON o_custkey = c_custkey
LEFT JOIN (SELECT s_suppkey, md5(s_name) AS memo_hash FROM supplier) ON s_suppkey = c_custkey""")
def jn_annotate_docs(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("reference"))
    states = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("reference")).agg(F.max("o_orderstatus").alias("state"))
    hashes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("reference"), F.md5("s_name").alias("memo_hash"))
    return ops.annotated(own, states, hashes)


@plans.query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def jn_docs_properties(spark, sf_dir):
    found = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return properties.missing_documents(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), found, "c_custkey")


@plans.query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def jn_tags_experiments(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(chosen, "o_custkey", "left_semi")


@plans.query("""WITH k AS (SELECT CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS id, event_type AS label, value FROM events),
a AS (SELECT id, label, max(value) AS homo FROM k WHERE label <> 'view' GROUP BY 1, 2),
b AS (SELECT id, label, min(value) AS lumo FROM k WHERE label <> 'click' GROUP BY 1, 2)
SELECT coalesce(a.id, b.id) AS "input-id", coalesce(a.label, b.label) AS label, homo, lumo
FROM a FULL OUTER JOIN b ON a.id IS NOT DISTINCT FROM b.id AND a.label IS NOT DISTINCT FROM b.label""")
def jn_property_merge(spark, sf_dir):
    key = F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("Input-Id")
    events = table(spark, sf_dir, "events").select(key, F.col("event_type").alias("label"), "value")
    one = events.where("label <> 'view'").groupBy("Input-Id", "label").agg(F.max("value").alias("Homo"))
    two = events.where("label <> 'click'").groupBy("Input-Id", "label").agg(F.min("value").alias("Lumo"))
    return properties.fold({"Homo": one, "Lumo": two})


@plans.query("""SELECT s_suppkey, s_name, coalesce(string_agg(CAST(p AS VARCHAR), ' ' ORDER BY p), '') AS parts FROM supplier
LEFT JOIN (SELECT DISTINCT l_suppkey, l_partkey AS p FROM lineitem WHERE l_quantity > 40) ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def jn_replica_match(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey").distinct()
    matched = properties.replica_match(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), lines, "s_suppkey", "l_partkey", "parts")
    return matched.withColumn("parts", F.array_join("parts", " "))
