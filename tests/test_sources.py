import zipfile

import pytest

from rowferry.model import Endpoint
from rowferry.operators.shards import KeyRange
from rowferry.sources import documents, files, jdbc, workbooks


def put(path, text):
    with open(path, "w", newline="") as f:
        f.write(text)
    return str(path)


def test_csv_quotes_and_newlines(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'id,note\n1,"a ""quoted"", text\nsecond line"\n2,\n')
    df = files.read_csv(spark, path)
    assert df.dtypes == [("id", "string"), ("note", "string")]
    assert [tuple(r) for r in df.collect()] == [("1", 'a "quoted", text\nsecond line'), ("2", "")]


@pytest.mark.parametrize("text", ["a,b\n1,2\n3\n", "a,b\n1,2\n3,4,5\n"])
def test_ragged_csv_fails_whatever_is_read(spark, tmp_path, text):
    df = files.read_csv(spark, put(tmp_path / "r.csv", text))
    for action in (df.collect, df.count, df.select("a").collect):
        with pytest.raises(Exception):
            action()


def test_csv_without_rows_or_anything(spark, tmp_path):
    assert files.read_csv(spark, put(tmp_path / "h.csv", "a,b\n")).collect() == []
    assert files.read_csv(spark, put(tmp_path / "e.csv", "")).columns == []


def test_csv_appends_with_sorted_columns(spark, out):
    for n in (1, 2):
        files.write_csv(spark.createDataFrame([(n, None)], "b int, a string"), out)
    df = files.read_csv(spark, out)
    assert df.columns == ["a", "b"] and sorted(tuple(r) for r in df.collect()) == [("", "1"), ("", "2")]


def test_list_tables(spark, tmp_path):
    for name in ("b.csv", "a.csv", "c.txt"):
        put(tmp_path / name, "x\n1\n")
    assert [r["table"] for r in files.list_tables(spark, str(tmp_path)).collect()] == ["a", "b"]


MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def workbook(path, sheets):
    """A minimal workbook; texts go to the shared strings, numbers inline."""
    strings, names, rels = [], [], []
    with zipfile.ZipFile(path, "w") as z:
        for i, (name, rows) in enumerate(sheets.items(), 1):
            names.append(f'<sheet name="{name}" sheetId="{i}" r:id="rId{i}"/>')
            rels.append(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>')
            body = ""
            for r, row in enumerate(rows, 1):
                cells = ""
                for c, v in enumerate(row):
                    if isinstance(v, str):
                        strings.append(v)
                        cells += f'<c r="{chr(65 + c)}{r}" t="s"><v>{len(strings) - 1}</v></c>'
                    elif v is not None:
                        cells += f'<c r="{chr(65 + c)}{r}"><v>{v}</v></c>'
                body += f'<row r="{r}">{cells}</row>'
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')
        relns = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{relns}"><sheets>{"".join(names)}</sheets></workbook>')
        pkg = "http://schemas.openxmlformats.org/package/2006/relationships"
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pkg}">{"".join(rels)}</Relationships>')
        items = "".join(f"<si><t>{s}</t></si>" for s in strings)
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{items}</sst>')


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"One": [["id", "name"], [1, "x"], [2]], "Two": [["z"], [9]]})
    workbook(tmp_path / "b.xlsx", {"Only": [["id", "extra"], [3, "e"]]})
    df = workbooks.read_workbooks(spark, str(tmp_path))
    assert df.columns == ["path", "sheet", "row_no", "extra", "id", "name"]
    got = sorted(tuple(r)[1:] for r in df.collect())
    assert got == [("One", 2, None, "1", "x"), ("One", 3, None, "2", None), ("Only", 2, "e", "3", None)]
    assert [r["sheet"] for r in workbooks.list_sheets(spark, str(tmp_path)).collect()] == ["One", "Two", "Only"]
    two = workbooks.read_workbooks(spark, f"{tmp_path}/a.xlsx", "Two", ["z"])
    assert [r["z"] for r in two.collect()] == ["9"]
    with pytest.raises(Exception, match="no sheet"):
        workbooks.read_workbooks(spark, f"{tmp_path}/b.xlsx", "Two", ["z"]).collect()


def test_documents(spark, tmp_path):
    path = put(tmp_path / "d.json", '{"_id": 1, "a": {"b": 2, "c": {"d": 3}}, "tags": ["x"]}\n{"_id": 2, "a": {"b": 5}}\n')
    assert documents.read_documents(spark, path).columns == ["_id", "a.b", "a.c.d", "tags"]
    part = documents.read_documents(spark, path, ["a.c"], '{"a.b": {"$lt": 5}}')
    assert part.columns == ["a.c.d"] and [tuple(r) for r in part.collect()] == [(3,)]


def test_jdbc_urls():
    base = dict(host="db", port=1, database="d")
    assert jdbc.jdbc_url(Endpoint("mysql", **base, extra="a=b")) == "jdbc:mysql://db:1/d?a=b"
    assert jdbc.jdbc_url(Endpoint("doris", **base)) == "jdbc:mysql://db:1/d"
    assert jdbc.jdbc_url(Endpoint("postgresql", **base)) == "jdbc:postgresql://db:1/d"
    assert jdbc.jdbc_url(Endpoint("clickhouse", **base)) == "jdbc:clickhouse://db:1/d"
    assert jdbc.jdbc_url(Endpoint("oracle", **base)) == "jdbc:oracle:thin:@//db:1/d"
    assert jdbc.jdbc_url(Endpoint("oracle", **base, extra="SID=ORCL")) == "jdbc:oracle:thin:@db:1:ORCL"
    with pytest.raises(ValueError):
        jdbc.jdbc_url(Endpoint("ftp"))


def test_endpoints_from_json():
    e = Endpoint.from_json('{"db_type": "MySQL", "host": "db", "port": 3306, "username": "u", "database_name": "d", "other": 1}')
    assert (e.kind, e.host, e.port, e.user, e.database) == ("mysql", "db", 3306, "u", "d")
    assert Endpoint.from_json('{"db_type": "csv", "host": "/data"}').path == "/data"
    with pytest.raises(ValueError):
        Endpoint.from_json("{}")


@pytest.mark.parametrize(
    "dialect, want",
    [
        ("mysql", "INSERT INTO t (`id`, `v`) SELECT DISTINCT `id`, `v` FROM s ON DUPLICATE KEY UPDATE `v` = VALUES(`v`)"),
        ("postgresql", 'INSERT INTO t ("id", "v") SELECT DISTINCT "id", "v" FROM s ON CONFLICT ("id") DO UPDATE SET "v" = EXCLUDED."v"'),
        (
            "oracle",
            'MERGE INTO t t USING (SELECT DISTINCT "ID", "V" FROM s) s ON (t."ID" = s."ID") WHEN MATCHED THEN UPDATE SET t."V" = s."V" '
            'WHEN NOT MATCHED THEN INSERT ("ID", "V") VALUES (s."ID", s."V")',
        ),
        ("clickhouse", "INSERT INTO t (id, v) SELECT DISTINCT id, v FROM s"),
    ],
)
def test_merge_statements(dialect, want):
    assert jdbc.merge_statement(dialect, "t", "s", ["id", "v"], ["id"]) == want


def test_merge_of_keys_alone_updates_nothing():
    assert jdbc.merge_statement("postgresql", "t", "s", ["a"], ["a"]).endswith("DO NOTHING")
    assert "UPDATE SET" not in jdbc.merge_statement("oracle", "t", "s", ["a"], ["a"])


def test_shard_predicates():
    assert KeyRange(0, 9, 2).predicates("k") == ["(`k` < 5 OR `k` IS NULL)", "`k` >= 5"]
    assert KeyRange(0, 0, 1).predicates("k") == ["true"]
