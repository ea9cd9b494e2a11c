"""Table operators over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import histogram, table as ops
from weftline.plans.registry import Plans
from weftline.sources.tables import table

plans = Plans()


@plans.query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def prj_columns(spark, sf_dir):
    return ops.select_strict(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_acctbal"])


@plans.query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation")
def prj_rename(spark, sf_dir):
    return table(spark, sf_dir, "nation").withColumnsRenamed({"n_nationkey": "id", "n_name": "name", "n_regionkey": "region"})


@plans.query("SELECT c_custkey, lower(c_name) AS c_name, c_nationkey, c_acctbal, lower(c_mktsegment) AS c_mktsegment FROM customer")
def prj_lower_values(spark, sf_dir):
    return ops.lower_values(table(spark, sf_dir, "customer"))


@plans.query("SELECT c_custkey, c_name FROM customer")
def prj_lower_names(spark, sf_dir):
    return ops.lower_names(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("C_CustKey"), F.col("c_name").alias("C_NAME")))


@plans.query(
    "SELECT n_nationkey, n_name, n_regionkey, NULL::INTEGER AS r_regionkey, NULL::VARCHAR AS r_name FROM nation"
    " UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name FROM region"
)
def prj_widen(spark, sf_dir):
    return ops.widen(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"))


@plans.query("SELECT s_suppkey AS value FROM supplier")
def prj_attr(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("Supp Key"))
    return suppliers.select(ops.column_of(suppliers, "suppKey").alias("value"))


@plans.query(
    "SELECT o_orderkey, o_totalprice, row_idx FROM (SELECT o_orderkey, o_totalprice,"
    " row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS row_idx FROM orders) WHERE row_idx BETWEEN 100 AND 299"
)
def prj_slice(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ops.slice_rows(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 100, 300)


@plans.query("SELECT p_partkey, p_retailprice * p_size AS stock, p_name FROM part")
def prj_add_column(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice", "p_size")
    return ops.add_column(parts, F.col("p_retailprice") * F.col("p_size"), "stock", 1).drop("p_retailprice", "p_size")


@plans.query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def prj_drop_column(spark, sf_dir):
    return ops.drop_at(table(spark, sf_dir, "supplier"), -1)


@plans.query(
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'overdrawn' ELSE c_mktsegment END AS c_mktsegment,"
    " CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer"
)
def prj_set_elements(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return ops.set_where(customers, F.col("c_acctbal") < 0, {"c_mktsegment": "overdrawn", "c_acctbal": 0.0})


@plans.query(
    "SELECT event_id, CASE WHEN event_type = 'error' THEN 'NaN' WHEN event_type = 'view' THEN 'inf'"
    " WHEN event_type = 'click' THEN '-inf' ELSE '1.5' END AS measured FROM events"
)
def prj_stringify_nan(spark, sf_dir):
    kind = F.col("event_type")
    value = F.when(kind == "error", float("nan")).when(kind == "view", float("inf")).when(kind == "click", float("-inf")).otherwise(1.5)
    return ops.stringify_nan(table(spark, sf_dir, "events").select("event_id", value.alias("measured")))


@plans.query("SELECT p_partkey, p_brand, p_size FROM part")
def prj_properties(spark, sf_dir):
    return ops.select_known(table(spark, sf_dir, "part"), ["p_size", "p_colour"], ["p_partkey", "p_brand"])


@plans.query("SELECT p_partkey, p_size, p_retailprice FROM part")
def prj_properties_strict(spark, sf_dir):
    return ops.select_strict(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], ["p_partkey"])


@plans.query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def flt_predicate(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where((F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@plans.query(
    "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders"
)
def srt_table(spark, sf_dir):
    return ops.sorted_table(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@plans.query(
    "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place"
    " FROM orders WHERE o_orderpriority = '1-URGENT'"
)
def srt_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = ops.filtered_sorted(orders, F.col("o_orderpriority") == "1-URGENT", "o_totalprice", "o_orderkey")
    return found.select("o_orderkey", "o_totalprice", "place")


@plans.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 20")
def lim_offset(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy("o_totalprice", "o_orderkey").offset(20).limit(50)


@plans.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def lim_n(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@plans.query(
    "SELECT 'supplier' AS label, s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier"
    " UNION ALL SELECT 'customer', c_custkey, c_name, c_acctbal FROM customer"
)
def set_union_label(spark, sf_dir):
    first = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    second = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return ops.union_labelled({"supplier": first, "customer": second})


@plans.query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except_nodes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@plans.query(
    "SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n_rows, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"
)
def set_partition(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey")
    return nations.agg(F.count(F.lit(1)).alias("n_rows"), F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


@plans.query("SELECT DISTINCT l_suppkey FROM lineitem")
def set_distinct_refs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_suppkey").distinct()


@plans.query("SELECT n_nationkey AS key, n_name AS name FROM nation JOIN region ON n_nationkey = r_regionkey UNION ALL SELECT r_regionkey, r_name FROM region")
def set_intersect_columns(spark, sf_dir):
    one = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_nationkey") == F.col("r_regionkey"))  # five regions
    one = one.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), "n_regionkey")
    two = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    shared = [c for c in one.columns if c in two.columns]
    return one.select(*shared).unionByName(two.select(*shared))


@plans.query(
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus, CAST(count(*) AS BIGINT) AS n_orders FROM orders GROUP BY 1, 2"
)
def jn_outer_transpose(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"))
    statuses = counts.select("o_orderstatus").distinct().count()
    return ops.outer_transpose(counts, "o_orderstatus", "y", statuses)


_BINS_SQL = """
WITH v AS (SELECT o_totalprice AS x FROM orders),
l AS (SELECT {low} AS low, {high} AS high, {w}::DOUBLE AS w, count(*) AS n FROM v),
b AS (SELECT low, high, w, n, CAST(ceil((high - low) / w) AS BIGINT) AS bins FROM l),
c AS (SELECT CASE WHEN x = high THEN bins - 1 ELSE CAST(floor((x - low) / w) AS BIGINT) END AS bin FROM v, b),
k AS (SELECT bin, count(*) AS n_in FROM c GROUP BY bin),
g AS (SELECT i AS bin, low + (i + 0.5) * w AS value, CAST(coalesce(n_in, 0) AS BIGINT) AS count, n
  FROM (SELECT unnest(range(bins)) AS i, low, w, n FROM b) LEFT JOIN k ON k.bin = i),
s AS (SELECT bin, round(value, 4) AS value, count, CAST(sum(count) OVER (ORDER BY bin) AS BIGINT) AS cumulative,
  round(count / n, 9) AS prob, sum(count) OVER (ORDER BY bin) / sum(count) OVER () AS cdf FROM g),
t AS (SELECT *, lag(cdf) OVER (ORDER BY bin) AS before FROM s)
SELECT bin, value, count, cumulative, prob, round(cdf, 9) AS cdf FROM t WHERE before IS NULL OR before < 1 - 1e-10"""


def _rounded(df):
    return df.select("bin", F.round("value", 4).alias("value"), "count", "cumulative", F.round("prob", 9).alias("prob"), F.round("cdf", 9).alias("cdf"))


@plans.query(_BINS_SQL.format(low="min(x) - 25000", high="max(x) + 25000", w=25000))
def agg_histogram_1d(spark, sf_dir):
    return _rounded(histogram.histogram_1d(table(spark, sf_dir, "orders"), "o_totalprice", 25_000))


@plans.query(_BINS_SQL.format(low="100000.0::DOUBLE", high="900000.0::DOUBLE", w=10000))
def agg_hist_trim(spark, sf_dir):
    return _rounded(histogram.histogram_1d(table(spark, sf_dir, "orders"), "o_totalprice", 10_000, 100_000, 900_000))


@plans.query("SELECT o_orderkey, round(o_totalprice / (SELECT avg(o_totalprice) FROM orders), 8) AS o_totalprice FROM orders")
def agg_mean_normalise(spark, sf_dir):
    normal = histogram.mean_normalised(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")
    return normal.withColumn("o_totalprice", F.round("o_totalprice", 8))


@plans.query("""
WITH l AS (SELECT min(p_size)::DOUBLE AS lx, max(p_size)::DOUBLE AS hx, min(p_retailprice) AS ly, max(p_retailprice) AS hy FROM part),
b AS (SELECT *, CAST(ceil((hx - lx) / 5.0) AS BIGINT) AS nx, CAST(ceil((hy - ly) / 20.0) AS BIGINT) AS ny FROM l),
c AS (SELECT CASE WHEN p_size = hx THEN nx - 1 ELSE CAST(floor((p_size - lx) / 5.0) AS BIGINT) END AS bin_x,
  CASE WHEN p_retailprice = hy THEN ny - 1 ELSE CAST(floor((p_retailprice - ly) / 20.0::DOUBLE) AS BIGINT) END AS bin_y FROM part, b),
k AS (SELECT bin_x, bin_y, count(*) AS n FROM c GROUP BY 1, 2),
g AS (SELECT x AS bin_x, y AS bin_y, lx, ly FROM (SELECT *, unnest(range(nx)) AS x FROM b), (SELECT unnest(range(ny)) AS y FROM b))
SELECT g.bin_x, g.bin_y, round(lx + (g.bin_x + 0.5) * 5.0, 4)::DOUBLE AS value_x, round(ly + (g.bin_y + 0.5) * 20.0, 4)::DOUBLE AS value_y,
  CAST(coalesce(n, 0) AS BIGINT) AS count
FROM g LEFT JOIN k ON k.bin_x = g.bin_x AND k.bin_y = g.bin_y""")
def agg_histogram_2d(spark, sf_dir):
    grid = histogram.histogram_2d(table(spark, sf_dir, "part"), "p_size", "p_retailprice", (5, 20))
    return grid.withColumns({"value_x": F.round("value_x", 4), "value_y": F.round("value_y", 4)})


@plans.query(
    "SELECT p_brand, CAST(count(*) AS BIGINT) AS n_rows, min(p_partkey) AS first_key, round(avg(p_retailprice), 4) AS mean_price FROM part GROUP BY p_brand"
)
def agg_key_groups(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("p_partkey").alias("first_key"), F.round(F.avg("p_retailprice"), 4).alias("mean_price")
    )
