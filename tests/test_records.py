"""CSV records in splits: every split edge gives what one pass over the file gives."""

import csv
import random

import pytest

from rowferry.sources import files, records


def put(path, text):
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)
    return str(path)


@pytest.fixture
def splits(spark):
    """Sets how large a split may be."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def use(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")

    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


def want(text):
    rows = list(csv.reader(text.splitlines(keepends=True), strict=True))
    return sorted(tuple(r) for r in rows[1:] if r)


def got(df):
    return sorted(tuple(r) for r in df.collect())


TRICKY = 'id,"no\nte",x\n1,"a ""quoted"", text\nsecond line",\n2,"",""""\n\n3,"\n\n\n\n""\n",z\r\n4,"é漢\r\n字",q\n5,plain,"end\n"'


@pytest.mark.parametrize("size", [1, 3, 7, 11, 17, 23, 40, 1000])
def test_quotes_at_every_split_edge(spark, tmp_path, splits, size):
    splits(size)
    df = files.read_csv(spark, put(tmp_path / "t.csv", TRICKY))
    assert df.columns == ["id", "no\nte", "x"]
    assert got(df) == want(TRICKY)


def test_random_files_in_random_splits(spark, tmp_path, splits):
    rng = random.Random(4)
    for n in range(6):
        folder = tmp_path / str(n)
        folder.mkdir()
        rows = []
        for name in ("a", "b"):
            own = [["".join(rng.choice('ab,"\n é') for _ in range(rng.randrange(12))) for _ in range(3)] for _ in range(rng.randrange(25))]
            with open(folder / f"{name}.csv", "w", newline="") as f:
                csv.writer(f, lineterminator=rng.choice(["\n", "\r\n"]), quoting=rng.choice([csv.QUOTE_ALL, csv.QUOTE_MINIMAL])).writerows([["p", "q", "r"], *own])
            rows += [tuple(r) for r in own]
        splits(rng.randrange(1, 90))
        assert got(files.read_csv(spark, str(folder))) == sorted(rows)


def test_one_newline_record_leaves_the_folder_split(spark, tmp_path, splits):
    splits(4000)
    text = "id,note\n" + "".join(f"{i},row {i}\n" for i in range(3000)) + '3000,"two\nlines"\n' + "".join(f"{i},row {i}\n" for i in range(3001, 6000))
    df = files.read_csv(spark, put(tmp_path / "big.csv", text))
    assert df.rdd.getNumPartitions() >= len(text) // 4000
    assert df.count() == 6000 and df.where("id = '3000'").first()["note"] == "two\nlines"


def test_record_over_many_splits(spark, tmp_path, splits):
    splits(50)
    long = "\n".join(f"line {i}" for i in range(200))
    df = files.read_csv(spark, put(tmp_path / "l.csv", f'a,b\n1,"{long}"\n2,x\n'))
    assert got(df) == [("1", long), ("2", "x")]
    header = files.read_csv(spark, put(tmp_path / "h.csv", f'"{long}",b\n1,2\n'))
    assert header.columns[1] == "b" and got(header) == [("1", "2")]


@pytest.mark.parametrize("text", ["a,b\n1,2\n3\n", "a,b\n1,2\n3,4,5\n", 'a,b\n1,2" x\n3,"4\n', 'a,b\n1,5" disk\n2,6" disk\n', 'a,b\n1,"never closed\n'])
def test_ragged_and_stray_quotes_fail_whatever_is_read(spark, tmp_path, text):
    path = put(tmp_path / "r.csv", text)
    for action in (lambda df: df.collect(), lambda df: df.count(), lambda df: df.select("a").collect()):
        with pytest.raises(Exception):
            action(files.read_csv(spark, path))


def test_files_with_other_headers_fail(spark, tmp_path):
    put(tmp_path / "a.csv", "a,b\n1,2\n")
    put(tmp_path / "b.csv", "b,a\n1,2\n")
    with pytest.raises(Exception, match="header"):
        files.read_csv(spark, str(tmp_path)).collect()


def test_where_splits_begin(spark, tmp_path, splits):
    splits(6)
    found = records.locate_records(records._lines(spark, put(tmp_path / "s.csv", 'a\n"1\n2\n3\n4\n5\n6\n7"\n8\n')))
    assert [r.inside for _, r in sorted(found.items())][0] is False
    homes = {r.home for r in found.values() if r.inside}
    assert len(homes) == 1 and any(r.inside for r in found.values())
