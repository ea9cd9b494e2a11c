"""Documents: predicates built from query values, files in documents, upserts by identity."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that make a document the same as another of its type.
IDENTITY = {
    "experiment": ("instance",),
    "component": ("instance", "stage", "name"),
    "user-metadata": ("instance",),
}


def uri_pattern(instance: str) -> str:
    """An instance without a scheme may stand behind any gateway."""
    return instance if instance.startswith("file://") else f".*{instance}"


def file_pattern(name: str) -> str:
    return name if name.startswith("/") else f".*{name}"


def component_reference(reference: str, stage: int | None = None) -> tuple[int | None, str]:
    """``stage<i>.<name>`` as stage and name; a stage that contradicts the given one is an error."""
    found = re.fullmatch(r"stage([0-9]+)\.(.+)", reference)
    if not found:
        return stage, reference
    if stage is not None and stage != int(found[1]):
        raise ValueError(f"{reference} is not in stage {stage}")
    return int(found[1]), found[2]


def matches(query: dict, anchored: bool = False, within: str = "") -> Column:
    """AND over a query: strings are patterns (found anywhere, or from the start), dicts nest, others are equal."""

    def one(name: str, value) -> Column:
        field = F.col(f"{within}{name}")
        if isinstance(value, dict):
            return matches(value, anchored, f"{within}{name}.")
        if isinstance(value, str):
            return field.rlike(f"^(?:{value})" if anchored else value)
        return field.isNull() if value is None else field == F.lit(value)

    return reduce(lambda a, b: a & b, [one(k, v) for k, v in query.items()], F.lit(True))


def doc_query(
    query: dict | None = None, instance: str | None = None, name: str | None = None, stage: int | None = None,
    type: str | None = None, files: str | None = None,
) -> Column:
    """The predicate for a user's query; arguments override entries of ``query``."""
    wanted = dict(query or {})
    pattern = wanted.pop("files", None)
    if name is not None:
        stage, name = component_reference(name, stage)
    given = {"instance": instance and uri_pattern(instance), "name": name, "stage": stage, "type": type}
    wanted |= {k: v for k, v in given.items() if v is not None}
    found = matches(wanted)
    pattern = files if files is not None else pattern
    return found & elem_match("files", file_pattern(pattern)) if pattern else found


def elem_match(files: str, pattern: str) -> Column:
    """True where any element matches."""
    return F.exists(F.col(files), lambda x: x.rlike(pattern))


def files_of(docs: DataFrame, pattern: str, key: str = "doc_id", files: str = "files") -> DataFrame:
    """``key, file`` for each file of a document that matches from the start."""
    return docs.select(key, F.explode(files).alias("file")).where(F.col("file").rlike(f"^(?:{file_pattern(pattern)})"))


def tables_of(files: DataFrame, pattern: str, file: str = "file", kinds: tuple[str, ...] = ("csv", "dat")) -> DataFrame:
    """Files of the given kinds whose name without folders matches from the start."""
    name = F.regexp_extract(file, r"([^/]*)$", 1)
    return files.where(F.lower(name).rlike(rf"\.({'|'.join(kinds)})$") & name.rlike(f"^(?:{pattern})"))


def distinct_values(docs: DataFrame, fields: list[str], chosen: Column | None = None) -> DataFrame:
    """Distinct combinations of the fields in the documents that the predicate chooses."""
    return (docs if chosen is None else docs.where(chosen)).select(*fields).distinct()


def upserted(docs: DataFrame, new: DataFrame, identity: list[str]) -> DataFrame:
    """``new`` in place of the documents with the same identity."""
    a, b = docs.alias("a"), new.select(*identity).distinct().alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in identity])
    return a.join(b, same, "left_anti").unionByName(new, allowMissingColumns=True)


def inserted_if_absent(docs: DataFrame, new: DataFrame, identity: list[str]) -> DataFrame:
    """``docs`` and those of ``new`` whose identity they lack."""
    a, b = new.alias("a"), docs.select(*identity).distinct().alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in identity])
    return docs.unionByName(a.join(b, same, "left_anti"), allowMissingColumns=True)


def tagged(docs: DataFrame, tags: DataFrame, key: str = "instance", column: str = "tags") -> DataFrame:
    """Tags (a map for each key) merged into the documents' own; new values win."""
    new = tags.select(key, F.col(column).alias("_new"))
    merged = F.map_from_entries(F.map_entries(F.map_filter(column, lambda k, _: ~F.map_contains_key(F.col("_new"), k))))
    with_new = F.when(F.col("_new").isNull(), F.col(column)).when(F.col(column).isNull(), F.col("_new"))
    return docs.join(new, key, "left").withColumn(column, with_new.otherwise(F.map_concat(merged, F.col("_new")))).drop("_new")


def annotated(docs: DataFrame, states: DataFrame, hashes: DataFrame, key: str = "reference") -> DataFrame:
    """Documents with state and hash; ``unknown`` and ``missing`` where there is none."""
    found = docs.join(states.select(key, "state"), key, "left").join(hashes.select(key, "memo_hash"), key, "left")
    return found.withColumns({"state": F.coalesce("state", F.lit("unknown")), "memo_hash": F.coalesce("memo_hash", F.lit("missing"))})


def file_groups(files: DataFrame) -> DataFrame:
    """``gateway, instance, files``: sorted files by the gateway and instance of their URI."""
    parts = files.select(
        F.regexp_extract("uri", r"^file://([^/]*)", 1).alias("gateway"), F.regexp_extract("uri", r"^file://[^/]*(.*)/[^/]*$", 1).alias("instance"), "uri"
    )
    return parts.groupBy("gateway", "instance").agg(F.sort_array(F.collect_list("uri")).alias("files"))
