"""Table functions for SQL: parsers whose output columns follow from what they are given.

    SELECT * FROM manifest_facts(TABLE(files), 'path', 'text')
    SELECT * FROM section_paths(TABLE(lines) PARTITION BY doc_id ORDER BY n)
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Sections of JSON manifests that hold names and versions, and those that hold commands or runtimes, by what a fact of them is.
PACKAGE = {"dependencies": "dependency", "devDependencies": "dependency", "peerDependencies": "dependency", "optionalDependencies": "dependency", "scripts": "command", "engines": "runtime"}
COMPOSER = {"require": "dependency", "require-dev": "dependency"}
_FACT = [("section", StringType()), ("kind", StringType()), ("name", StringType()), ("value", StringType())]
_REQUIREMENT = re.compile(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*([^;#]*)")


def _required(section: str, entries) -> Iterator[tuple]:
    for entry in entries if isinstance(entries, list) else []:
        if m := _REQUIREMENT.match(str(entry)):
            yield section, "dependency", m[1], m[2].strip()


def _mapped(section: str, kind: str, entries) -> Iterator[tuple]:
    for name, value in entries.items() if isinstance(entries, dict) else []:
        told = value.get("version", "") if isinstance(value, dict) else value
        yield section, kind, str(name), "" if told is None else str(told)


def _json(text: str, sections: dict[str, str]) -> Iterator[tuple]:
    data = json.loads(text)
    for section, kind in sections.items():
        yield from _mapped(section, kind, data.get(section)) if isinstance(data, dict) else ()


def _project(text: str) -> Iterator[tuple]:
    data = tomllib.loads(text)
    project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
    if "requires-python" in project:
        yield "project", "runtime", "python", str(project["requires-python"])
    yield from _required("dependencies", project.get("dependencies"))
    for group, entries in project.get("optional-dependencies", {}).items():
        yield from _required(group, entries)
    yield from _mapped("poetry", "dependency", poetry.get("dependencies"))
    for group, own in poetry.get("group", {}).items():
        yield from _mapped(f"poetry.{group}", "dependency", own.get("dependencies"))
    for section, scripts in (("scripts", project.get("scripts")), ("poetry.scripts", poetry.get("scripts"))):
        yield from _mapped(section, "command", scripts)


def _crate(text: str) -> Iterator[tuple]:
    data = tomllib.loads(text)
    for section in ("dependencies", "dev-dependencies", "build-dependencies"):
        yield from _mapped(section, "dependency", data.get(section))


def _requirements(text: str) -> Iterator[tuple]:
    for line in text.splitlines():
        if line.strip() and not line.lstrip().startswith(("#", "-")):
            yield from _required("requirements", [line])


FORMATS = {
    "package.json": lambda text: _json(text, PACKAGE),
    "composer.json": lambda text: _json(text, COMPOSER),
    "pyproject.toml": _project,
    "cargo.toml": _crate,
    "requirements.txt": _requirements,
}


@udtf
class ManifestFacts:
    """The given table's columns but for its text, and section, kind, name, value of every fact of its manifests, by their file names; what can't be parsed has no facts."""

    @staticmethod
    def analyze(files: AnalyzeArgument, path: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        if not files.isTable or {path.value, text.value} - set(files.dataType.names):
            raise ValueError("manifest_facts takes a table and the names of its columns of paths and texts")
        own = [f for f in files.dataType.fields if f.name != text.value]
        return AnalyzeResult(StructType([*own, *(StructField(n, t) for n, t in _FACT)]))

    def eval(self, row, path: str, text: str) -> Iterator[tuple]:
        parse = FORMATS.get((row[path] or "").rpartition("/")[2].lower())
        try:
            facts = list(parse(row[text] or "")) if parse else []
        except ValueError:  # no JSON, no TOML
            facts = []
        own = [v for k, v in row.asDict().items() if k != text]
        for fact in facts:
            yield (*own, *fact)


@udtf
class SectionPaths:
    """For each line of a partition, in its order: the table's columns, the headings it stands below, joined, and how many they are. The one state are the open headings."""

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        if not lines.isTable or "line" not in lines.dataType.names:
            raise ValueError("section_paths takes a table with a column line")
        return AnalyzeResult(StructType([*lines.dataType.fields, StructField("section", StringType()), StructField("depth", IntegerType())]))

    def __init__(self):
        self.open: list[tuple[int, str]] = []

    def eval(self, row) -> Iterator[tuple]:
        if m := re.match(r"(#{1,6})\s+(.*\S)", row["line"] or ""):
            while self.open and self.open[-1][0] >= len(m[1]):
                self.open.pop()
            self.open.append((len(m[1]), m[2]))
        yield (*row, " > ".join(title for _, title in self.open), len(self.open))


def register(spark: SparkSession) -> None:
    """Makes manifest_facts and section_paths known to the session's SQL."""
    spark.udtf.register("manifest_facts", ManifestFacts)
    spark.udtf.register("section_paths", SectionPaths)
