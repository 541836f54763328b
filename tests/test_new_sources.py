"""Workbooks, open build records, file streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from runlens.sources import builds, registry, tables, workbooks
from runlens.streaming import lifecycle as live


def test_workbooks_come_back_with_their_types(spark, tmp_path):
    books = {
        "a.xlsx": {"one & two": [["id", "name", "when", "ok"], [1, "é <b>", dt.datetime(2024, 2, 29, 13, 5), True], [2, None, dt.date(2024, 1, 1), False], [3, "é <b>"]], "empty": []},
        "b.xlsx": {"one & two": [["id", "name", "when", "ok"], ["x", " spaced ", None, None]]},
    }
    for name, sheets in books.items():
        (tmp_path / name).write_bytes(workbooks.workbook_bytes(sheets))
    cells = workbooks.read_workbooks(spark, str(tmp_path))
    assert cells.rdd.getNumPartitions() == 3
    assert [r.cells for r in cells.where("file like '%a.xlsx'").orderBy("row").collect()] == [
        ["id", "name", "when", "ok"], ["1", "é <b>", "2024-02-29 13:05:00", "true"], ["2", None, "2024-01-01", "false"], ["3", "é <b>"]]
    entry = {"component_type": ".xlsx", "path": str(tmp_path)}
    typed = registry.read_input(spark, entry, "id int, name string, `when` timestamp_ntz, ok boolean", sheet="one & two")
    assert rows(typed) == sorted([
        (1, "é <b>", dt.datetime(2024, 2, 29, 13, 5), True), (2, None, dt.datetime(2024, 1, 1), False), (3, "é <b>", None, None), (None, " spaced ", None, None)], key=repr)


def test_cells_without_references_and_own_date_formats():
    assert workbooks._column("AB12") == 27 and workbooks._moment(0.5) == "1899-12-30 12:00:00" and workbooks._moment(45351.0) == "2024-02-29"
    from xml.etree import ElementTree

    row = ElementTree.fromstring(f'<row xmlns="{workbooks.MAIN[1:-1]}"><c t="inlineStr"><is><t>x</t></is></c><c><v>7</v></c><c/></row>')
    assert [workbooks._value(c, [], set()) for c in row] == ["x", "7", None]


def test_open_build_records_keep_unknown_fields(spark):
    texts = ['{"builds": [{"number": 1, "extra": {"a": [5]}}, {"number": "no"}]}', "no json", '{"builds": []}', '{"other": 1}', None]
    df = spark.createDataFrame([(t,) for t in texts], "json string")
    got = builds.open_builds_from_text(df, extra={"a": ("$.extra.a[0]", "int")})
    assert rows(got, "number", "a", "url") == [(1, 5, None), (None, None, None)]
    assert [r[0] for r in got.where("number = 1").select(F.to_json("record")).collect()] == ['{"extra":{"a":[5]},"number":1}']


@pytest.mark.parametrize("files_per_batch", [1, 10])
def test_each_file_lands_once(spark, tmp_path, files_per_batch):
    folder, counts = tmp_path / "in", f"{tmp_path}/counts"
    write = registry.landing_writer(counts)

    def run():
        live.start_available(registry.file_stream(spark, str(folder), files_per_batch=files_per_batch), write, f"{tmp_path}/state").awaitTermination()

    for name in ("x/a.csv", "y/a.csv", "y/b.csv"):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text("1")
    run(), run()
    (folder / "y/c.csv").write_text("2")
    run()
    found = registry.landed(spark, counts)
    assert rows(found) == [("a.csv", 2), ("b.csv", 1), ("c.csv", 1)]
    entries = spark.createDataFrame([(1, "A.CSV", 5), (2, "other", 1)], "id int, job_name string, file_uploaded long")
    assert rows(registry.registry_with_landed(entries, found)) == [(1, "A.CSV", 7), (2, "other", 1)]


def test_a_small_batch_of_files_is_one_job(spark, tmp_path):
    folder, counts = tmp_path / "in", f"{tmp_path}/counts"
    for i in range(480):
        path = folder / f"job={i % 7}" / f"{i}.csv"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("1")
    names = ["spark.sql.sources.parallelPartitionDiscovery.threshold", "spark.sql.streaming.fileSource.log.compactInterval"]
    usual = [spark.conf.get(n) for n in names]
    name = F.regexp_extract("path", "job=([^/]*)/", 1)
    stream = live.start_available(registry.file_stream(spark, str(folder), files_per_batch=40), registry.landing_writer(counts, name, few=True), f"{tmp_path}/state")
    assert [spark.conf.get(n) for n in names] == usual  # of this session
    stream.awaitTermination()
    assert sum(1 for _ in (tmp_path / "state/commits").glob("[0-9]*")) == 12
    assert not list((tmp_path / "state/sources/0").glob("*.compact"))  # all files seen so far are not written every ten batches
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(str(stream.runId))
    assert 12 <= len(jobs) <= 14  # one a batch, and the first listing
    assert rows(registry.landed(spark, counts)) == sorted(((str(i), 480 // 7 + (i < 480 % 7)) for i in range(7)), key=repr)


def test_columns_of_several_tables(spark):
    got = tables.describe_all(a=spark.range(1), b=spark.createDataFrame([("x", 1)], "s string, n int"))
    assert rows(got, "table_name", "position", "name", "type") == [("a", 0, "id", "bigint"), ("b", 0, "s", "string"), ("b", 1, "n", "int")]
