import os
import tempfile
from datetime import datetime

import pytest

from rowferry.functions.names import export_path, quote_name, safe_name
from rowferry.functions.typemap import TYPE_MAP, map_types, spark_type

AT = datetime(1998, 12, 1, 23, 4, 56)


def test_export_paths():
    assert export_path("/lake/out", "Late orders / EU", AT) == "/lake/out/Late-orders-EU-19981201-230456.csv"
    assert export_path("/lake/out/report.csv", "lines", AT) == "/lake/out/lines-19981201-230456.csv"
    assert export_path("", "lines", AT).startswith(tempfile.gettempdir() + os.sep)
    assert export_path("", "部品 一覧", AT).endswith("部品-一覧-19981201-230456.csv")
    assert export_path("", "lines", AT) != export_path("", "lines", AT.replace(minute=5))
    assert safe_name("-- ** --") == "export"


def test_quoting():
    got = [quote_name("l`tax", "mysql"), quote_name('l"tax', "postgresql"), quote_name("l_tax", "oracle"), quote_name("l_tax", "csv")]
    assert got == ["`l``tax`", '"l""tax"', '"L_TAX"', "l_tax"]


def mapped(spark, source, target, *types):
    df = spark.createDataFrame([(i, source, t) for i, t in enumerate(types)], "i int, dialect string, raw_type string")
    return [r["mapped_type"] for r in map_types(df, target).orderBy("i").collect()]


def test_every_listed_pair_maps_whatever_the_case_and_the_blanks(spark):
    for (source, target), pairs in TYPE_MAP.items():
        plain = [k for k in pairs]
        assert mapped(spark, source, target, *plain) == [pairs[k] for k in plain]
        assert mapped(spark, source, target, *[f" {k.lower()} " for k in plain]) == [pairs[k] for k in plain]


def test_a_size_is_kept_where_both_sides_take_one(spark):
    assert mapped(spark, "mysql", "oracle", "VARCHAR(73)", "DECIMAL(17,5)") == ["VARCHAR2(73)", "NUMBER(17,5)"]
    assert mapped(spark, "oracle", "mysql", "NUMBER(12,4)") == ["DECIMAL(12,4)"]


def test_a_size_falls_where_the_target_has_its_own(spark):
    assert mapped(spark, "mysql", "oracle", "BIGINT(14)") == ["NUMBER(19)"]
    assert mapped(spark, "mysql", "postgresql", "TINYINT(3)") == mapped(spark, "mysql", "postgresql", "TINYINT")


def test_a_sized_name_of_its_own_comes_before_the_bare_one(spark):
    assert mapped(spark, "mysql", "postgresql", "TINYINT(1)") == ["BOOLEAN"]
    assert mapped(spark, "oracle", "postgresql", "NUMBER(1)") == ["BOOLEAN"]


def test_what_nobody_lists_stays_in_capitals(spark):
    assert mapped(spark, "mysql", "postgresql", "hyperbox", "Geometry(7)") == ["HYPERBOX", "GEOMETRY(7)"]
    assert mapped(spark, "clickhouse", "mysql", "int128") == ["INT128"]


@pytest.mark.parametrize(
    "raw, dialect, want",
    [("tinyint(1)", "", "boolean"), ("Number(19)", "", "bigint"), ("decimal(9, 3)", "", "decimal(9,3)"), ("varchar(5)", "", "string"), ("bytea", "", "binary"), ("date", "", "date"), ("date", "oracle", "timestamp_ntz"), ("float", "oracle", "double"), ("json", "", "string")],
)
def test_spark_types(raw, dialect, want):
    assert (spark_type(raw, dialect) if dialect else spark_type(raw)) == want
