"""Stages of the pipeline keep columns of any name."""

import random

import pytest

from tessera.llm import exact_dedup, language_id, ngram_join, pii

NAMES = ["key", "row", "found_id", "kept_id", "all", "pages", "reach", "__key", "__id", "__all", "__lang", "found_lang", "hash", "part", "group_size", "best", "a.b"]


@pytest.mark.parametrize("stage", [exact_dedup.without_copies, ngram_join.one_of_each, pii.redacted, language_id.in_a_language])
def test_columns_of_any_name(spark, stage):
    r = random.Random(1)
    words = [["the", "and", "house", "tree", "walking", "there"], ["der", "und", "haus", "baum", "gehen", "dort"]]
    rows = []
    for i in range(40):
        text = " ".join(r.choices(words[i % 2], k=40)) + (" mail me@example.org" if i == 3 else "")
        rows.append((i, text, ["en", "de"][i % 2], "s", len(text), *(f"{n}{i}" for n in NAMES)))
    rows.append((100, rows[5][1], "de", "s", 1, *(f"{n}100" for n in NAMES)))
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    df = spark.createDataFrame(rows, schema)
    out = stage(df)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) >= 20 and all(x[n] == f"{n}{x.doc_id}" for x in got for n in NAMES)
