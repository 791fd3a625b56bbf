"""What shows only at larger sizes: rows that the small tables lack, by query and SQL, and tasks."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tests.compare import both


def agree(spark, folder, name, files=1, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(files).write.parquet(f"{folder}/{table}.parquet")
    got, want = both(spark, str(folder), catalog.queries()[name], catalog.oracle_sql()[name])
    assert got == want
    return [dict(zip(got[0], r, strict=True)) for r in got[1]]


def test_a_question_read_backwards_that_has_sources_gets_them(spark, tmp_path):
    docs = [(1, "enod si siht"), (2, "this is done"), (3, "nothing")]
    rows = agree(spark, tmp_path, "contexts_of_questions", benchmark=([(5, "this is done")], "item_id long, text string"), documents=(docs, "doc_id long, text string"))
    assert {r["query_id"]: r["sources"] for r in rows} == {"5": "1", "-6": "1"}


def test_sizes_half_way_go_to_the_even_thousand(spark, tmp_path):
    orders = [(1, 1, 400500.0), (2, 1, 400500.0), (3, 2, 401500.0), (4, 2, 398500.0), (5, 2, 1.0)]
    rows = agree(spark, tmp_path, "halved_batches", orders=(orders, "o_orderkey long, o_custkey long, o_totalprice double"))
    assert [(r["lo"], r["hi"]) for r in rows if r["o_custkey"] == "1"] == [("1", "2")]


def test_leases_of_one_millisecond_and_events_of_many_files(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    at = lambda minute: start + datetime.timedelta(minutes=minute)
    kinds = [("purchase", 9), ("purchase", 5), ("error", 7), ("signup", 3), ("signup", 1)]
    rows = [(500 * u + n, at(1000 * u), u, kind) for u in range(8) for kind, n in (kinds[u % 5 :] + kinds[: u % 5])]
    rows += [(7, at(20 * u), 50, "purchase" if u % 3 else "error") for u in range(12)]
    rows += [(9, at(500), 60 + u % 2, "purchase" if u < 2 else "error") for u in range(4)]
    found = agree(spark, tmp_path, "streamed_leases", files=12, events=(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string"))
    own = sorted(r["state"] for r in found if r["object_id"] == "0" and r["owner"] == "a")
    assert own == ["granted", "released", "renewed"]


def test_events_without_an_object_are_one_object_s_and_ends_at_the_watermark_are_open(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    at = lambda minute: start + datetime.timedelta(minutes=minute)
    big = (1 << 53) + 1
    rows = [(n, at(5 * n), None, kind) for n, kind in enumerate(["purchase", "signup", "purchase", "error", "signup", "purchase"])]
    rows += [(2, at(3), 0, "purchase"), (2, at(4), big, "purchase"), (9, at(80), big + 2, "purchase"), (8, at(80), big, "purchase"), (1, at(100), 7, "purchase")]
    found = agree(spark, tmp_path, "streamed_leases", events=(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string"))
    own = lambda user: sorted(r["state"] for r in found if r["object_id"] == str(user))
    assert (own(0), own(big), own(big + 2)) == (["expired", "granted"], ["expired", "expired", "granted", "granted"], ["granted"])
    assert len(own(None)) == 10


@pytest.mark.parametrize("name", ["cleaned_tags", "facts_by_table_function"])
def test_a_small_table_s_work_is_dealt_to_many_tasks(spark, name):
    rows = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert rows.select(F.spark_partition_id()).distinct().count() > 2
