"""Facts of manifests and other files as rows: dependencies, commands, images, ports, variables."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound
from ..sources.captions import numbered

SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
#: Line patterns by kind of fact; group 1 is the name, group 2 the value.
LINES = {
    "requirement": r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*((?:[=<>!~]=?|@).*)?$",
    "image": r"(?i)^\s*(FROM)\s+(\S+)",
    "port": r"(?i)^\s*(EXPOSE)\s+([0-9]+)",
    "target": r"^([A-Za-z0-9_-]+):(?!=)\s*(.*)$",
    "variable": r"^\s*(?:export\s+)?([A-Z][A-Z0-9_]+)=(.*)$",
}


def package_dependencies(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, section, name, version from JSON manifests; what isn't such JSON gives no rows."""
    schema = ", ".join(f"{s} map<string,string>" for s in SECTIONS)
    entries = bound(F.from_json(F.col(text), schema), lambda record: F.flatten(F.array(*(_entries(record[s], s) for s in SECTIONS))))
    return files.select(key, F.explode(entries).alias("f")).select(key, "f.section", "f.name", "f.version")


def _entries(column, section: str):
    kind = "array<struct<section:string,name:string,version:string>>"
    found = F.transform(F.map_entries(column), lambda e: F.struct(F.lit(section).alias("section"), e["key"].alias("name"), e["value"].alias("version")))
    return F.coalesce(found.cast(kind), F.array().cast(kind))


def line_facts(files: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """key, line_number, name, value of the lines that a kind's pattern matches; comments are no facts."""
    rows = numbered(files, key, text).where(~F.col("line").rlike(r"^\s*(#|//|$)"))
    pattern = LINES[kind]
    return rows.where(F.col("line").rlike(pattern)).select(key, "line_number", F.regexp_extract("line", pattern, 1).alias("name"), F.trim(F.regexp_extract("line", pattern, 2)).alias("value"))


_REQUIREMENT = re.compile(r"^([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*(.*)$")


def _manifest(text: str | None) -> Iterator[tuple[str, str, str]]:
    """(section, name, version) of a project or crate manifest; nothing if it isn't TOML."""
    try:
        data = tomllib.loads(text or "")
    except tomllib.TOMLDecodeError:
        return
    project = data.get("project", {})
    if "requires-python" in project:
        yield "runtime", "python", str(project["requires-python"])
    lists = {"dependencies": project.get("dependencies", []), **project.get("optional-dependencies", {})}
    for section, entries in lists.items():
        for entry in entries:
            if m := _REQUIREMENT.match(entry):
                yield section, m[1], m[2]
    for section in ("dependencies", "dev-dependencies", "build-dependencies"):
        for name, value in data.get(section, {}).items():
            yield section, name, value if isinstance(value, str) else str(value.get("version", ""))


def toml_dependencies(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, section, name, version from project and crate manifests in TOML."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([(k, *f) for k, t in zip(rows[key], rows[text], strict=True) for f in _manifest(t)], columns=[key, "section", "name", "version"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, text).mapInPandas(run, f"{key} {kind}, section string, name string, version string")


def within_blocks(files: DataFrame, key: str, text: str, opens: str, closes: str) -> DataFrame:
    """key, line_number, line of the lines between one that opens a block and the next that closes it."""
    rows = numbered(files, key, text)
    mark = F.when(F.col("line").rlike(opens), 1).when(F.col("line").rlike(closes), 0)
    so_far = Window.partitionBy(key).orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("__in", F.last(mark, ignorenulls=True).over(so_far)).where("__in = 1")
    return inside.where(~F.col("line").rlike(opens)).drop("__in")


def module_requirements(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, name, version of a Go module's requirements, single or in blocks, and of its language."""
    block = within_blocks(files, key, text, r"^require\s*\(\s*$", r"^\)\s*$")
    single = numbered(files, key, text).where(F.col("line").rlike(r"^require\s+[^\s(]")).withColumn("line", F.regexp_replace("line", r"^require\s+", ""))
    go = numbered(files, key, text).where(F.col("line").rlike(r"^go\s+[0-9]"))
    pattern = r"^\s*([^\s/][^\s]*)\s+(v?[0-9][^\s]*)"
    rows = block.unionByName(single).unionByName(go).where(F.col("line").rlike(pattern))
    return rows.select(key, F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("version"))


def json_sections(files: DataFrame, key: str, text: str, sections: dict[str, str]) -> DataFrame:
    """key, section, name, version of the string maps of a JSON manifest; sections: names in the file and what they are called here."""
    record = F.from_json(F.col(text), ", ".join(f"`{s}` map<string,string>" for s in sections))
    entries = F.flatten(F.array(*(_entries(record[s], name) for s, name in sections.items())))
    return files.select(key, F.explode(entries).alias("f")).select(key, "f.section", "f.name", "f.version")


def variables(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, name of environment variables that code reads, in three ways of writing it."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (r"process\.env\.([A-Z][A-Z0-9_]+)", r"os\.environ(?:\.get\(|\[)['\"]([A-Z][A-Z0-9_]+)", r"getenv\(['\"]([A-Z][A-Z0-9_]+)"))))
    return files.select(key, F.explode(F.array_distinct(found)).alias("name"))


def submodules(files: DataFrame, key: str, text: str, most: int = 1000) -> DataFrame:
    """key, place, path: the first `most` different paths that a file declares, in order."""
    paths = F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\s*path\s*=\s*(\S+)\s*$"), F.lit(1))), 1, most)
    return files.select(key, F.posexplode(paths).alias("place", "path"))
