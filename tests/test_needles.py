import random

from pyspark.sql import functions as F

from tessera.functions import tables
from tessera.operators import needles


def test_needles_equal_brute_force(spark):
    r = random.Random(1)
    make = lambda n: "".join(r.choices("ab é\n", k=n))
    texts = [(i, make(r.randint(0, 300))) for i in range(80)] + [(80, None), (81, "")]
    words = sorted({make(r.randint(1, 5)) for _ in range(200)} | {"absent words"})
    df = spark.createDataFrame([(w,) for w in words] + [(None,), ("",), (words[0],)], "w string")
    for size in (20_000, 30):
        parts = needles.shards(df, "w", size)
        got = sorted(map(tuple, needles.found(spark.createDataFrame(texts, "k long, t string"), ["k"], "t", parts).collect()))
        want = sorted((k, w, t.find(w), sum(t.startswith(w, i) for i in range(len(t)))) for k, t in texts if t for w in words if w in t)
        assert got == want
    assert parts.count() > 3 and needles.found(spark.createDataFrame(texts, "k long, t string"), ["k"], "t", parts.limit(0)).count() == 0


def test_table_functions(spark):
    tables.register(spark)
    files = [("x/package.json", '{"dependencies": {"a": "1"}, "scripts": {"t": "run"}, "engines": {"node": 18}, "devDependencies": null}', 1), ("pyproject.toml", "[tool.poetry.dependencies]\nb = {version='2', extras=['x']}\nc='*'\n[tool.poetry.group.dev.dependencies]\nd='1'\n[project]\ndependencies=['e[f]>=1; python_version<\"3\"']\n[project.scripts]\ng='h:i'\n", 2), ("package.json", "[]", 3), ("Cargo.toml", "=", 4), ("y", None, 5), (None, "x", 6), ("requirements.txt", "# c\n-r x\nz>=1 # why\n\nq\n", 7)]
    spark.createDataFrame(files, "path string, text string, n int").createOrReplaceTempView("some_files")
    df = spark.sql("SELECT * FROM manifest_facts(TABLE(some_files), 'path', 'text')")
    assert df.dtypes == [("path", "string"), ("n", "int"), ("section", "string"), ("kind", "string"), ("name", "string"), ("value", "string")]
    got = sorted(tuple(r)[1:] for r in df.collect())
    assert got == [(1, "dependencies", "dependency", "a", "1"), (1, "engines", "runtime", "node", "18"), (1, "scripts", "command", "t", "run"), (2, "dependencies", "dependency", "e", ">=1"), (2, "poetry", "dependency", "b", "2"), (2, "poetry", "dependency", "c", "*"), (2, "poetry.dev", "dependency", "d", "1"), (2, "scripts", "command", "g", "h:i"), (7, "requirements", "dependency", "q", ""), (7, "requirements", "dependency", "z", ">=1")]
    lines = [(1, i, x) for i, x in enumerate(["a", "# A", "b", "### B", "## C", "c", "# D", None])] + [(2, 0, "x")]
    spark.createDataFrame(lines, "k int, n int, line string").repartition(3).createOrReplaceTempView("some_lines")
    got = spark.sql("SELECT * FROM section_paths(TABLE(some_lines) PARTITION BY k ORDER BY n)").orderBy("k", "n").collect()
    assert [r.section for r in got] == ["", "A", "A", "A > B", "A > C", "A > C", "D", "D", ""] and F is not None
