"""Hand-made cases, where the tables above don't reach."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftline.functions import refs
from weftline.operators import documents, graph, histogram, history, properties, status
from weftline.operators import table as tables
from weftline.sources import delimited, files


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_histogram_edges(spark):
    df = frame(spark, [(float(x),) for x in (0, 1, 2, 3, 10)], "x double")
    bins = histogram.histogram_1d(df, "x", 2).orderBy("bin").collect()
    assert [r["count"] for r in bins] == [0, 2, 2, 0, 0, 0, 1]
    assert bins[0]["value"] == -1.0 and bins[-1]["cdf"] == 1.0
    bins = histogram.histogram_1d(df, "x", 2, 0, 4).orderBy("bin").collect()
    assert [(r["count"], r["cumulative"]) for r in bins] == [(2, 2), (2, 4)]
    assert bins[0]["prob"] == 2 / 5  # of all points, the outlier too
    top = histogram.histogram_1d(frame(spark, [(0.0,), (4.0,), (4.0,)], "x double"), "x", 2, 0, 4).orderBy("bin").collect()
    assert [r["count"] for r in top] == [1, 2]  # the upper limit belongs to the last bin


def test_histogram_2d_outliers(spark):
    df = frame(spark, [(0.0, 0.0), (1.0, 9.0), (5.0, 1.0)], "x double, y double")
    grid = histogram.histogram_2d(df, "x", "y", (1, 5), (0, 0), (2, 10))
    assert grid.count() == 4 and grid.agg(F.sum("count")).first()[0] == 2


def test_null_keys_meet(spark):
    one = frame(spark, [(None, 1), ("a", 2)], "id string, x int")
    two = frame(spark, [(None, 5), ("b", 6)], "id string, y int")
    found = {tuple(r) for r in properties.natural_outer(one, two).collect()}
    assert found == {(None, 1, 5), ("a", 2, None), ("b", None, 6)}
    with pytest.raises(ValueError):
        properties.fold({"z": one})


def test_slice_needs_step_one(spark):
    with pytest.raises(ValueError):
        tables.slice_rows(spark.range(3).toDF("id"), [F.col("id")], 0, 2, 2)
    assert tables.slice_rows(spark.range(0).toDF("id"), [F.col("id")], 0, 2).count() == 0


def test_outer_transpose_reports_a_missing_key(spark):
    df = frame(spark, [("a", 1), ("a", 2), ("b", 1)], "label string, k int")
    with pytest.raises(PySparkException, match="lacks the key 2"):
        tables.outer_transpose(df, "label", "k", 2).collect()


def test_names(spark):
    assert tables.title_of("boilingPoint") == "Boiling Point"
    df = spark.range(1).toDF("id")
    assert tables.drop_at(tables.add_column(df, F.lit(1)), -1).columns == ["id"]
    with pytest.raises(KeyError):
        tables.select_strict(df, ["no"])
    assert tables.equal_tables(df, df) and not tables.equal_tables(df, df.union(df))


def test_component_reference():
    assert documents.component_reference("stage2.x") == (2, "x")
    with pytest.raises(ValueError):
        documents.component_reference("stage2.x", 1)


@pytest.mark.parametrize(
    "replicas, failed, wanted",
    [
        ([("r0", "component_shutdown", True), ("r1", "finished", True)], False, False),
        ([("r0", "component_shutdown", True), ("r1", "component_shutdown", True)], False, True),
        ([("r0", "finished", True), ("s", "component_shutdown", False)], False, True),
        ([("r0", "failed", True), ("r1", "finished", True)], True, True),
    ],
)
def test_shutdown_into_a_fan_in(spark, replicas, failed, wanted):
    nodes = frame(spark, [*[(n, s, r, False) for n, s, r in replicas], ("agg", "initialising", False, True)], "reference string, state string, is_replica boolean, is_aggregate boolean")
    edges = frame(spark, [(n, "agg") for n, _, _ in replicas], "src string, dst string")
    assert status.shutdown_rule(nodes, edges).first()["shut"] is wanted


def test_replica_counts_must_agree(spark):
    edges = frame(spark, [(0, 2), (1, 2)], "src int, dst int")
    good = frame(spark, [(0, 3, False), (1, None, False), (2, None, False)], "node int, replicas int, aggregates boolean")
    assert {tuple(r) for r in graph.propagate_replicas(good, edges).collect()} == {(0, 3), (1, None), (2, 3)}
    bad = frame(spark, [(0, 3, False), (1, 4, False), (2, None, False)], "node int, replicas int, aggregates boolean")
    with pytest.raises(PySparkException, match="replica counts differ"):
        graph.propagate_replicas(bad, edges).collect()


def test_cycles_are_found(spark):
    nodes = frame(spark, [(0,), (1,)], "node int")
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(nodes, frame(spark, [(0, 1), (1, 0)], "src int, dst int"))


def test_latest_iteration_is_a_number(spark):
    rows = frame(spark, [(0, "x", "9"), (0, "x", "10")], "stage int, name string, iteration string")
    assert graph.latest_iterations(rows).first()["iteration"] == 10


def test_placeholders(spark):
    runs = frame(spark, [("a", "finished"), ("b", "finished"), ("c", "finished")], "name string, state string")
    said = frame(spark, [("a", " False "), ("b", "true"), ("c", "perhaps")], "name string, condition string")
    assert {tuple(r) for r in graph.placeholder_state(runs, said).collect()} == {("a", "finished"), ("b", "running"), ("c", "failed")}


def test_block_hash_changes_with_producers(spark):
    nodes = frame(spark, [(0, "a", "i", None), (1, "b", "i", None)], "node int, command string, image string, content string")
    edges = frame(spark, [(0, 1)], "src int, dst int")
    one = {r["node"]: r["memo_hash"] for r in graph.memo_hashes(nodes, edges).collect()}
    two = {r["node"]: r["memo_hash"] for r in graph.memo_hashes(nodes.replace("a", "c", "command"), edges).collect()}
    assert one[0] != two[0] and one[1] != two[1]


def test_next_success_is_strictly_later(spark):
    t = dt.datetime(2024, 1, 1)
    day = dt.timedelta(days=1)
    runs = frame(spark, [(1, 0, t, 5.0, 0), (1, 1, t + 3 * day, 5.0, 1), (1, 2, t + 4 * day, 5.0, 0)], "reference int, seq int, launch_ts timestamp_ntz, run_s double, exit_code int")
    asked = frame(spark, [(1, t), (1, t - day), (1, t + 9 * day), (2, t)], "reference int, ts timestamp_ntz")
    found = {(r["reference"], r["ts"]): r["next_seq"] for r in history.next_success(asked, runs).collect()}
    assert found == {(1, t): 2, (1, t - day): 0, (1, t + 9 * day): None, (2, t): None}


def test_long_and_broken_runs(spark):
    rows = [("a", 0, "010224-101500", "90000.25", "None"), ("a", 1, "020224-101500", "N/A", "0")]
    raw = frame(spark, rows, "reference string, seq int, `component-launch-time` string, `task-run-time` string, `exit-code` string")
    found = files.normalised_history(raw).orderBy("seq").collect()
    assert found[0]["run_s"] == 90000.25 and found[0]["exit_code"] == 1
    assert found[1]["run_s"] is None and found[1]["launch_ts"] == dt.datetime(2024, 2, 2, 10, 15)


def test_dialects():
    assert delimited.sniffed(["# by hand", "input-id;LambdaMax;label;"]).names == ("input-id", "LambdaMax", "label")
    assert delimited.sniffed(["smiles", "C"]).names == ("smiles",)
    assert delimited.sniffed(["1,2"], header=None).header is False


def test_csv_promotion_and_comments(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# c\na, b , c\n1,2,x\n# in the body\n\n2.5,3,7\n")
    df = delimited.read_delimited(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"a": "double", "b": "bigint", "c": "string"}
    assert sorted(tuple(r) for r in df.collect()) == [(1.0, 2, "x"), (2.5, 3, "7")]


def test_interpolation():
    known = {"a": "%(b)s x", "b": "h2 h4", "i": "1"}
    assert refs.interpolate("run %(a)s %(b)s[1]", known) == "run h2 h4 x h4"
    with pytest.raises(KeyError, match="did you mean 'number'"):
        refs.interpolate("%(numbr)s", {"number": 1})
    with pytest.raises(ValueError):
        refs.interpolate("%(a", known)
    assert refs.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": None, "c": 3}, "d": 4}) == {"a": {"b": 1, "c": 3}, "d": 4}
    assert refs.with_text_keys({1: {None: [2]}}) == {"1": {"None": [2]}}
    assert refs.flattened({"a": [1, {"b": 2}]}) == {"/a/0": "1", "/a/1/b": "2"}


def test_router_wants_an_exit_code(spark):
    row = frame(spark, [("a", 1, False, False, True, None)], "reference string, seq int, queued boolean, started boolean, stopped boolean, exit_code int")
    with pytest.raises(PySparkException, match="no exit code"):
        history.routed_events(row).collect()
