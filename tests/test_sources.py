from __future__ import annotations

from datetime import date, datetime

import pytest

from twinframe import compare
from twinframe.sources.export import export, export_format
from twinframe.sources.files import detect_format, read_source, resolve_uri
from twinframe.sources.queries import partitioned_options, query_options, read_query
from twinframe.sources.typed import loaded_type, typed_load


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv(spark, tmp_path):
    path = write(tmp_path / "t.csv", "id,name,amount,day,seen,ok\n1,a,1.5,2024-01-15,2024-01-15 10:00:00,true\n2,,2,,,\n")
    df = read_source(spark, path)
    assert dict(df.dtypes) == {
        "id": "bigint",
        "name": "string",
        "amount": "double",
        "day": "date",
        "seen": "timestamp_ntz",
        "ok": "boolean",
    }
    assert df.first() == (1, "a", 1.5, date(2024, 1, 15), datetime(2024, 1, 15, 10), True)


@pytest.mark.parametrize("sep", [",", "|", ";", "\t"])
def test_csv_separator_is_found(spark, tmp_path, sep):
    path = write(tmp_path / "t.csv", f'id{sep}"a,b;c|d"\n1{sep}x\n')
    assert read_source(spark, path).columns == ["id", "a,b;c|d"]


def test_csv_quotes_spaces_and_line_breaks(spark, tmp_path):
    path = write(tmp_path / "t.csv", 'id,text\n1,"say ""hi"", \n twice"\n2,  padded \n')
    rows = [tuple(r) for r in read_source(spark, path).orderBy("id").collect()]
    assert rows == [(1, 'say "hi", \n twice'), (2, "  padded ")]


def test_csv_with_schema_checks_the_header(spark, tmp_path):
    path = write(tmp_path / "t.csv", "id,name\n1,a\n")
    assert read_source(spark, path, schema="id int, name string").first() == (1, "a")
    with pytest.raises(Exception, match="(?i)header"):
        read_source(spark, path, schema="name string, id int").collect()


def test_missing_file(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_source(spark, str(tmp_path / "absent.csv"))


def test_json_lines_and_arrays(spark, tmp_path):
    lines = write(tmp_path / "t.jsonl", '{"id": 1, "at": "2024-01-15 10:00:00"}\n{"id": 2}\n')
    array = write(tmp_path / "t.json", '[{"id": 1},\n {"id": 2}]\n')
    assert read_source(spark, lines).dtypes == [("at", "timestamp_ntz"), ("id", "bigint")]
    assert sorted(r.id for r in read_source(spark, array).collect()) == [1, 2]
    assert read_source(spark, lines, schema="id int").count() == 2


def test_format_follows_the_ending():
    assert detect_format("s3://b/x.PARQUET?versionId=3") == "parquet"
    assert [detect_format(f"x{e}") for e in (".pq", ".csv", ".json", ".jsonl")] == ["parquet", "csv", "json", "json"]
    with pytest.raises(ValueError, match="Unsupported file type"):
        detect_format("x.txt")


def test_uris():
    assert resolve_uri(" S3://b/x.csv ") == "s3a://b/x.csv"
    assert resolve_uri("gs://b/x.csv") == "gs://b/x.csv"
    assert resolve_uri("/data/x.csv") == "/data/x.csv"
    for bad in ("https://h/x.csv", "ftp://h/x.csv", " "):
        with pytest.raises(ValueError):
            resolve_uri(bad)


def test_query_options():
    assert query_options("jdbc:postgresql://h/d", " SELECT 1; ", fetchsize=1000) == {
        "url": "jdbc:postgresql://h/d",
        "query": "SELECT 1",
        "fetchsize": "1000",
    }
    split = partitioned_options("jdbc:x:y", "SELECT * FROM t", "id", 1, 100, 8)
    assert split["dbtable"] == "(SELECT * FROM t) source" and split["numPartitions"] == "8" and "query" not in split
    for url, text in (("jdbc:x:y", " ; "), ("postgres://h", "SELECT 1")):
        with pytest.raises(ValueError):
            query_options(url, text)


def test_partitioned_query_needs_a_partition_count(spark):
    with pytest.raises(ValueError, match="num_partitions"):
        read_query(spark, "jdbc:x:y", "SELECT 1", partition_column="id", bounds=(1, 2))


def test_typed_load(frame):
    cells = frame("c array<string>", (["1.5", "x", "true"],), ([None, "y"],), (["2", "z", "false"],))
    df = typed_load(cells, {"n": "FIXED", "t": "TEXT", "b": "boolean"}, cells="c")
    assert df.dtypes == [("n", "double"), ("t", "string"), ("b", "boolean")]
    assert [tuple(r) for r in df.collect()] == [(1.5, "x", True), (None, "y", None), (2.0, "z", False)]
    with pytest.raises(ValueError, match="no columns"):
        typed_load(cells, {}, cells="c")
    assert typed_load(cells.limit(0), {"n": "FIXED"}, cells="c").count() == 0


def test_typed_load_of_columns(frame):
    df = typed_load(frame("i string, d string", ("7", "2024-01-15")), [("d", "DATE"), ("i", "INTEGER")])
    assert df.dtypes == [("d", "date"), ("i", "bigint")] and df.first() == (date(2024, 1, 15), 7)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        typed_load(frame("i string", ("seven",)), {"i": "INTEGER"}).collect()


def test_loaded_types():
    kinds = ["NUMBER", "float8", "BYTEINT", "TIMESTAMP_TZ", "TIME", "VARIANT", "BINARY", "GEOGRAPHY"]
    assert [loaded_type(k) for k in kinds] == [
        "double", "double", "bigint", "timestamp", "string", "string", "string", "string",
    ]


def test_export_formats():
    assert [export_format(p) for p in ("a.parquet", "a.pq", "a.json", "a.csv", "a")] == [
        "parquet", "parquet", "json", "csv", "csv",
    ]
    assert export_format("a.csv", "json") == "json"
    with pytest.raises(ValueError, match="Export format"):
        export_format("a", "xlsx")


ROWS = [(1, 'q"x, \n y', datetime(2024, 1, 1, 0, 0, 0, 123456), None), (2, "  ", None, 0.1), (3, "", None, 1e300)]


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
@pytest.mark.parametrize("single_file", [False, True])
def test_export_reads_back(spark, frame, tmp_path, fmt, single_file):
    df = frame("id bigint, s string, t timestamp_ntz, d double", *ROWS).repartition(3)
    path = tmp_path / f"out.{fmt}"
    assert export(df, str(path), order=["id"], single_file=single_file) == 3
    parts = [p for p in path.iterdir() if p.name.startswith("part-")]
    assert len(parts) == 1 or not single_file
    back = read_source(spark, str(path)).select(*df.columns)
    assert back.dtypes == df.dtypes
    # An empty cell of a CSV file is read as NULL, quoted or not.
    expected = [tuple(None if fmt == "csv" and v == "" else v for v in row) for row in ROWS]
    assert [tuple(r) for r in back.orderBy("id").collect()] == expected


def test_csv_export_has_a_header_and_one_line_per_row(spark, frame, tmp_path):
    a, b = frame("id int, v int", (2, 1), (1, 1), (3, 1)), frame("id int, v int", (1, 2), (2, 3), (3, 1))
    comparison = compare(a, b, pk_columns=["id"])
    path = tmp_path / "diffs"
    assert export(comparison.rows("diffs", flags=False), str(path), "csv", comparison.order, single_file=True) == 2
    (part,) = [p for p in path.iterdir() if p.name.startswith("part-")]
    assert part.read_text().splitlines() == ["pk_id_a,pk_id_b,v_a,v_b", "1,1,1,2", "2,2,1,3"]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        export(a, str(path), "csv")


def test_csv_export_writes_nested_values_as_json(frame, tmp_path):
    df = frame("id int, l array<int>", (1, [1, 2]))
    export(df, str(tmp_path / "n"), "csv", single_file=True)
    (part,) = [p for p in (tmp_path / "n").iterdir() if p.name.startswith("part-")]
    assert part.read_text().splitlines()[1] == '1,"[1,2]"'


@pytest.mark.parametrize("text", ["id,v\n1,a\n2,b,c\n", "id,v\n1,a\n3\n"])
def test_ragged_csv_raises(spark, tmp_path, text):
    (tmp_path / "x.csv").write_text(text)
    with pytest.raises(Exception, match="MALFORMED"):
        read_source(spark, str(tmp_path / "x.csv")).collect()


def test_values_of_another_type_raise(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id\n1\nx\n")
    with pytest.raises(Exception, match="MALFORMED"):
        read_source(spark, str(tmp_path / "x.csv"), schema="id bigint").collect()
    (tmp_path / "x.jsonl").write_text('{"id":1}\n{"id":2\n')
    with pytest.raises(Exception, match="MALFORMED"):
        read_source(spark, str(tmp_path / "x.jsonl")).collect()


def test_files_of_one_folder_may_differ_in_shape(spark, tmp_path):
    folder = tmp_path / "mixed.json"
    folder.mkdir()
    (folder / "a.json").write_text('\n[\n{"id": 1, "v": "x"},\n{"id": 2}\n]\n')
    (folder / "b.json").write_text('{"id": 3}\n\n{"id": 4, "w": 1.5}\n{"id": 5}\n')
    (folder / "c.json").write_text("")
    for schema in (None, "id bigint, v string"):
        assert sorted(r.id for r in read_source(spark, str(folder), schema=schema).collect()) == [1, 2, 3, 4, 5]
    (tmp_path / "x.jsonl").write_text('[{"id": 1}]\n[{"id": 2}, {"id": 3}]\n')
    assert sorted(r.id for r in read_source(spark, str(tmp_path / "x.jsonl")).collect()) == [1, 2, 3]
    (tmp_path / "y.json").write_text('{\n"id": 1\n}\n')
    with pytest.raises(ValueError, match="multi_line"):
        read_source(spark, str(tmp_path / "y.json"))
    assert read_source(spark, str(tmp_path / "y.json"), multi_line=True).first().id == 1


def test_separators_must_agree(spark, tmp_path):
    folder = tmp_path / "mixed.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("id;v\n1;a\n")
    (folder / "b.csv").write_text('id;v\n2;"b,c,d"\n')
    assert sorted(tuple(r) for r in read_source(spark, str(folder)).collect()) == [(1, "a"), (2, "b,c,d")]
    (folder / "c.csv").write_text("id,v\n3,a\n")
    with pytest.raises(ValueError, match="differently"):
        read_source(spark, str(folder))


def test_offsets_are_kept(spark, frame, tmp_path):
    zoned = ["2024-11-03T05:30:00Z", "2024-11-03T06:30:00Z", "2024-11-03T01:30:00-05:00"]
    (tmp_path / "x.csv").write_text("id,at,local\n" + "".join(f"{i},{t},2024-11-03T01:30:00\n" for i, t in enumerate(zoned)))
    (tmp_path / "x.json").write_text("".join(f'{{"id":{i},"at":"{t}","local":"2024-11-03T01:30:00"}}\n' for i, t in enumerate(zoned)))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for name in ("x.csv", "x.json"):
            df = read_source(spark, str(tmp_path / name))
            assert (df.schema["at"].dataType.simpleString(), df.schema["local"].dataType.simpleString()) == ("timestamp", "timestamp_ntz")
            hours = [r.h for r in df.orderBy("id").selectExpr("unix_seconds(at) DIV 1800 AS h").collect()]
            assert [h - hours[0] for h in hours] == [0, 2, 2]
        kinds = [("a", "TIMESTAMP_TZ"), ("b", "TIMESTAMP_LTZ"), ("c", "TIMESTAMP_NTZ")]
        row = typed_load(frame("a string, b string, c string", ("2024-01-01T10:00:00+02:00", "2024-01-01T10:00:00-05:00", "2024-01-01T10:00:00")), kinds)
        assert row.selectExpr("unix_seconds(b) - unix_seconds(a) AS apart").first().apart == 7 * 3600
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert spark.conf.get("spark.sql.timestampType") == "TIMESTAMP_LTZ"


def test_surplus_cells_raise(frame):
    cells = frame("c array<string>", (["1", "x", "surplus"],))
    with pytest.raises(Exception, match="more than 2 cells"):
        typed_load(cells, {"n": "FIXED", "t": "TEXT"}, cells="c").collect()
