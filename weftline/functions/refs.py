"""References, identifiers and small texts as column expressions, and driver-side counterparts."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders that are no producers, and ways to use a reference.
SPECIAL_FOLDERS = ("input", "data", "bin", "conf")
METHODS = ("copy", "link", "ref", "copyout", "extract", "output", "loopref", "loopoutput")
SIZES = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12, "ki": 2**10, "mi": 2**20, "gi": 2**30, "ti": 2**40}


def parse_producer(reference: Column, stage: Column | None = None) -> Column:
    """``stage<i>.<name>`` as a struct ``stage, name, has_index``; without a stage, the given one."""
    text = r"^stage([0-9]+)[^.]*\.(.*)$"
    own = F.regexp_extract(reference, text, 1)
    has = (own != "") & ~reference.startswith("/")
    given = F.lit(None).cast("int") if stage is None else stage
    return F.struct(
        F.when(has, own.cast("int")).otherwise(given).alias("stage"),
        F.when(has, F.regexp_extract(reference, text, 2)).otherwise(reference).alias("name"),
        F.coalesce(has, F.lit(False)).alias("has_index"),
    )


def parse_dataref(value: Column) -> Column:
    """``producer[/path]:method`` as a struct ``producer, file, method``; NULL unless there is one colon.

    An absolute path is folder and file; a special folder keeps its path.
    """
    parts = F.split(value, ":")
    ref, method = F.get(parts, 0), F.get(parts, 1)
    first = F.split_part(ref, F.lit("/"), F.lit(1))
    absolute, special = ref.startswith("/"), first.isin(*SPECIAL_FOLDERS)
    folder = F.regexp_extract(ref, r"^(.*?)/*[^/]*$", 1)
    producer = F.when(absolute, F.when(folder == "", "/").otherwise(folder)).when(special | ~F.contains(ref, F.lit("/")), ref).otherwise(first)
    file = F.when(absolute, F.regexp_extract(ref, r"([^/]*)$", 1)).when(~special & F.contains(ref, F.lit("/")), F.regexp_extract(ref, r"^[^/]*/(.*)$", 1))
    return F.when(F.size(parts) == 2, F.struct(producer.alias("producer"), file.alias("file"), method.alias("method")))


def compile_ref(stage: Column, name: Column, file: Column, method: Column) -> Column:
    """The reference that ``parse_producer`` and ``parse_dataref`` take apart."""
    return F.concat(
        F.when(stage.isNotNull(), F.concat(F.lit("stage"), stage.cast("string"), F.lit("."))).otherwise(""), name,
        F.when(file.isNotNull(), F.concat(F.lit("/"), file)).otherwise(""), F.lit(":"), method,
    )


def split_replica(name: Column) -> Column:
    """``name12`` as a struct ``name, replica``; the digits at the end count."""
    digits = F.regexp_extract(name, r"^(.*?)([0-9]+)$", 2)
    return F.struct(
        F.when(digits != "", F.regexp_extract(name, r"^(.*?)([0-9]+)$", 1)).otherwise(name).alias("name"),
        F.when(digits != "", digits.cast("long")).alias("replica"),
    )


def array_access(text: Column, index: Column | int) -> Column:
    """An element of words separated by white space; NULL beyond the end."""
    return F.get(F.split(F.btrim(text), r"\s+"), F.lit(index) if isinstance(index, int) else index)


def variables_in(text: Column) -> Column:
    """Names of ``%(name)s`` in a text, distinct, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"%\(([A-Za-z0-9_.-]+)\)s"), F.lit(1)))


def references_in(text: Column) -> Column:
    """Data references in a text, distinct."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"([A-Za-z0-9_./#-]+:(?:{'|'.join(METHODS)}))\b"), F.lit(1)))


def memory_bytes(text: Column) -> Column:
    """A size with suffix (``Mi``, ``G``…) in bytes; NULL where it is none."""
    pattern = r"^\s*([0-9]+)\s*([A-Za-z]*)\s*$"
    number = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("long")
    unit = F.regexp_replace(F.lower(F.regexp_extract(text, pattern, 2)), "b$", "")
    factor = F.lit(None).cast("long")
    for suffix, size in SIZES.items():
        factor = F.when(unit == suffix, F.lit(size).cast("long")).otherwise(factor)
    return number * factor


def to_boolean(text: Column, short: bool = False) -> Column:
    """Yes, no, true and false in any case (and their letters, if ``short``); else NULL."""
    said = F.lower(F.btrim(text))
    yes, no = (("yes", "true", *("y",) * short), ("no", "false", *("n",) * short))
    return F.when(said.isin(*yes), True).when(said.isin(*no), False)


def stage_index(text: Column) -> Column:
    return F.regexp_extract(text, r"^(?:stage)?([0-9]+)$", 1).try_cast("int")


def uri_parts(uri: Column) -> Column:
    """``scheme://gateway/path`` as a struct."""
    part = lambda i: F.regexp_extract(uri, r"^([a-z0-9]+)://([^/]*)(/.*)?$", i)
    return F.struct(part(1).alias("scheme"), part(2).alias("gateway"), part(3).alias("path"))


def s3_parts(uri: Column) -> Column:
    part = lambda i: F.regexp_extract(uri, r"^s3a?://([^/]+)/?(.*)$", i)
    return F.struct(part(1).alias("bucket"), part(2).alias("key"))


def image_parts(image: Column) -> Column:
    """A container image as a struct ``registry, name, tag``; a registry has a dot, a port or is ``localhost``."""
    pattern = r"^(?:((?:[^/]*[.:][^/]*)|localhost)/)?([^:@]+)(?:[:@](.*))?$"
    part = lambda i: F.nullif(F.regexp_extract(image, pattern, i), F.lit(""))
    return F.struct(part(1).alias("registry"), part(2).alias("name"), F.coalesce(part(3), F.lit("latest")).alias("tag"))


def path_rename(text: Column) -> Column:
    r"""``src[:target]`` as a struct; ``\:`` is a colon of the path; without a target, the source's last part."""
    hidden = F.replace(text, F.lit("\\:"), F.lit("\x00"))
    shown = lambda c: F.replace(c, F.lit("\x00"), F.lit(":"))
    source = shown(F.split_part(hidden, F.lit(":"), F.lit(1)))
    target = shown(F.split_part(hidden, F.lit(":"), F.lit(2)))
    return F.struct(source.alias("source"), F.when(target != "", target).otherwise(F.regexp_extract(source, r"([^/]*)/*$", 1)).alias("target"))


def uid_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("&"), F.lit("%26"))


def struct_digest(*columns: Column, sep: str = "\x01") -> Column:
    """md5 of values in order of their position; ``sep=""`` gives the ambiguous form without separators."""
    return F.md5(F.concat_ws(sep, *columns))


def map_digest(values: Column) -> Column:
    """md5 of a map whatever its order."""
    return F.md5(F.to_json(F.map_from_entries(F.sort_array(F.map_entries(values)))))


def without_empty(values: Column) -> Column:
    return F.map_filter(values, lambda _, v: v.isNotNull() & (v != ""))


def overridden(one: Column, two: Column) -> Column:
    """Two maps as one; values of the second win unless NULL."""
    return F.map_zip_with(one, two, lambda _, a, b: F.coalesce(b, a))


# -- on the driver, for definitions ---------------------------------------------------


def interpolate(text: str, variables: dict[str, object], most: int = 100) -> str:
    """``%(name)s`` replaced, variables in variables too; ``a b c[1]``-like access to words of a variable."""
    pattern = re.compile(r"%\(([^()%]+)\)s(?:\[([0-9]+)\])?")
    for _ in range(most):
        found = pattern.search(text)
        if not found:
            if "%(" in text:
                raise ValueError(f"incomplete pattern in {text!r}")
            return text
        name, index = found.groups()
        if name not in variables:
            raise KeyError(f"no variable {name!r}{suggestion(name, list(variables))}")
        value = str(variables[name])
        if index is not None and "%(" in value:
            value = interpolate(value, variables, most)
        text = text[: found.start()] + (value.split()[int(index)] if index is not None else value) + text[found.end() :]
    raise ValueError("variables refer to each other in a circle")


def suggestion(name: str, known: list[str]) -> str:
    near = difflib.get_close_matches(name, known, n=1, cutoff=0.8)
    return f"; did you mean {near[0]!r}?" if near else ""


def merged(one, two):
    """Two nested definitions as one: dicts unite, other values of the second win unless None."""
    if isinstance(one, dict) and isinstance(two, dict):
        return {k: merged(one.get(k), two.get(k)) for k in [*one, *[k for k in two if k not in one]]}
    return one if two is None else two


def flattened(value, path: str = "") -> dict[str, str]:
    """``path -> text`` of the leaves of a nested definition."""
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
    if items is None:
        return {path: str(value)}
    return {k: v for name, x in items for k, v in flattened(x, f"{path}/{name}").items()}


def with_text_keys(value):
    """Keys of nested dicts as text."""
    if isinstance(value, dict):
        return {str(k): with_text_keys(v) for k, v in value.items()}
    return [with_text_keys(v) for v in value] if isinstance(value, list) else value
