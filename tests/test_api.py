"""Reader, cursor and writer."""

import pyarrow as pa
import pytest

from colonnade.api import Reader, Writer
from colonnade.sources.files import WriterOptions


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('api')}/t"
    with Writer(spark, at, "row_no long not null, st struct<x:int,y:string>", WriterOptions(codec="zlib")) as w:
        rows = spark.range(300).selectExpr("id as row_no", "named_struct('x', cast(id as int), 'y', string(id)) as st")
        w.write(rows.where("row_no < 200"))
        w.write(rows.where("row_no >= 200"))
    return at


def test_reader(spark, path):
    with Reader(spark, path) as file:
        assert file.number_of_rows == 300
        assert [c.path for c in file.schema] == ["", "row_no", "st", "st.x", "st.y"]
        assert file.schema_table().count() == 5
        assert {r["codec"] for r in file.options().collect()} == {"ZLIB"}
        assert file.statistics().where("column_id = 0").selectExpr("sum(n_values)").first()[0] == 300
        assert file.scan([0, 2, 4]).columns == ["st_y"]


def test_cursor(spark, path):
    cursor = Reader(spark, path).batches(ids=[0, 1], size=128, row_no="row_no")
    assert [b.num_rows for b in cursor] == [128, 128, 44] and cursor.next() is None
    cursor.seek(290)
    assert cursor.next().column(0).to_pylist() == list(range(290, 300))
    cursor.seek(300)
    assert cursor.next() is None
    for row in (-1, 301):
        with pytest.raises(ValueError):
            cursor.seek(row)
    cursor.seek(0)
    assert cursor.next().num_rows == 128
    cursor.close()
    assert cursor.next() is None
    plain = Reader(spark, path).batches(size=1000)
    plain.seek(100)
    assert plain.next().num_rows == 200


def test_writer_takes_arrow_and_checks_nulls(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    with Writer(spark, at, "a long not null") as w:
        w.write(pa.table({"a": [1, 2]}))
        w.write(pa.RecordBatch.from_pydict({"a": [3]}))
        with pytest.raises(Exception, match="null in a"):
            w.write(pa.table({"a": pa.array([None], pa.int64())}))
    assert Reader(spark, at).number_of_rows == 3
    with Writer(spark, at, "a long"):
        pass
    assert Reader(spark, at, "a long").df.count() == 0
    with pytest.raises(ValueError):
        Writer(spark, at, "v interval day to second")
