"""Landing as a stream: the rows do not depend on how pages fall into batches."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from factloom.sources.registry import DATASETS
from factloom.streaming import streams

BASIC = DATASETS["stock_basic"]
FIELDS = ["ts_code", "symbol", "name", "exchange", "list_status"]
SWAPPED = ["symbol", "ts_code", "name"]


def page(folder, run, number, fields, names, code=0):
    items = [[f"{n}.SZ" if f == "ts_code" else n for f in fields] for n in names]
    (folder / f"{run}.page{number}.json").write_text(json.dumps({"code": code, "msg": "", "data": {"fields": fields, "items": items}}))


def landed(spark, path):
    rows = streams.read_batches(spark, path, "run_id string, offset long, payload map<string,string>")
    return sorted((r.run_id, r.offset, r.payload["ts_code"]) for r in rows.collect())


def vendor_run(folder):
    page(folder, "a", 0, FIELDS, ["a0", "a00"])
    page(folder, "a", 1, FIELDS[:3], ["a1"])  # expected fields only are missing
    page(folder, "a", 2, SWAPPED, ["a2"])  # another signature: the run ends
    page(folder, "a", 3, FIELDS, ["a3"])
    page(folder, "b", 0, FIELDS, ["b0", "a0"])  # one row is known
    page(folder, "b", 1, ["ts_code"], ["b1"])  # a required field is missing
    for n in range(4):
        page(folder, "c", n, FIELDS, [f"c{n}"], code=0)
    page(folder, "d", 0, FIELDS, ["d0"])
    page(folder, "d", 1, FIELDS, ["d1"], code=-2001)  # no answer, so the next page waits
    page(folder, "d", 2, FIELDS, ["d2"])


@pytest.mark.parametrize("files", [1, 1000])
def test_rows_do_not_depend_on_the_batches(spark, tmp_path, files):
    (tmp_path / "in").mkdir()
    vendor_run(tmp_path / "in")
    args = (spark, f"{tmp_path}/in", BASIC, f"{tmp_path}/raw", f"{tmp_path}/cp", files)
    streams.stream_land(*args).awaitTermination()
    got = landed(spark, f"{tmp_path}/raw")
    # Which run brings the row that two of them hold is a matter of arrival; that it comes once is not.
    assert [x for x in got if x[2] != "a0.SZ"] == [
        ("a", 0, "a00.SZ"), ("a", 1, "a1.SZ"), ("b", 0, "b0.SZ"), *[("c", n, f"c{n}.SZ") for n in range(4)], ("d", 0, "d0.SZ"),
    ]
    assert len([x for x in got if x[2] == "a0.SZ"]) == 1
    # The missing page comes later: what waited for it lands too, and nothing lands twice.
    page(tmp_path / "in", "d", 1, FIELDS, ["d1"])
    (tmp_path / "in" / "d.page1.json").rename(tmp_path / "in" / "e.page0.json")
    page(tmp_path / "in", "c", 4, FIELDS, ["c4", "c0"])
    streams.stream_land(*args).awaitTermination()
    assert sorted(set(landed(spark, f"{tmp_path}/raw")) - set(got)) == [("c", 4, "c4.SZ"), ("e", 0, "d1.SZ")]


def test_early_pages_wait_and_repeats_bring_nothing_new(spark, tmp_path):
    schema = "dataset string, run_id string, offset long, code int, msg string, fields array<string>, items array<array<string>>"
    body = lambda n, fields=FIELDS: ("stock_basic", "r", n, 0, "", fields, [[f"{n}.SZ", "s", "n", "e", "L"]])
    for k, rows in enumerate([[body(20), body(10)], [body(0), body(0)], [body(30), body(10), body(40, SWAPPED), body(50)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        streams.land_pages(stream, BASIC, f"{tmp_path}/raw", f"{tmp_path}/cp", step=10).awaitTermination()
        assert [x[1] for x in landed(spark, f"{tmp_path}/raw")] == [[], [0, 10, 20], [0, 10, 20, 30]][k]


def test_a_sink_that_cannot_be_read_is_not_empty(spark, tmp_path):
    assert streams.read_batches(spark, f"{tmp_path}/none", "a int").count() == 0
    (tmp_path / "raw" / "batch=0").mkdir(parents=True)
    (tmp_path / "raw" / "batch=0" / "x.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        streams.read_batches(spark, f"{tmp_path}/raw", "a int").agg(F.max("a")).collect()
