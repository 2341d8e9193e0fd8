"""Files of exports: one for each key, few folders, keys as they were."""

from __future__ import annotations

from pathlib import Path

import pytest

from tidemark.sources import files

KEYS = ["A", "a b", "BRK:B", "50%", "C++", "x=y", "%41", "_hidden", ".hidden", "Ü?", "D.csv", 'q"[1]^', "key=A"]


def test_a_key_is_a_file(spark, tmp_path):
    """Texts that CSV must quote come back, an export before goes, and few folders are made."""
    rows = [(k, n, None if n % 3 == 0 else f'{k}, "{n}"\\', n / 7) for k in KEYS for n in range(5)]
    df = spark.createDataFrame(rows, "key string, n int, text string, x double").repartition(7)
    files.export_by_key(df.where("key = 'A'").selectExpr("'gone' AS key", "n"), "key", f"file://{tmp_path}/out")
    files.export_by_key(df, "key", f"file://{tmp_path}/out")
    again = files.scan(spark, f"{tmp_path}/out", "n int, text string, x double", "key")
    assert sorted(map(str, again.select("key", "n", "text", "x").collect())) == sorted(map(str, df.collect()))
    found = [x for x in Path(tmp_path, "out").rglob("*") if x.is_file()]
    assert len(found) == len(KEYS) and not any(x.name.startswith(("_", ".")) for x in found) and all(x.name.startswith("key=") for x in found)
    assert sorted(r.key for r in files.complete_keys(spark, f"{tmp_path}/out", ["n", "x"], "key").collect()) == sorted(KEYS)


def test_many_keys_are_few_folders(spark, tmp_path):
    files.export_by_key(spark.range(2000).selectExpr("id AS key", "id AS n"), "key", f"{tmp_path}/out")
    assert len(list((tmp_path / "out").iterdir())) <= files.FOLDERS and len(list((tmp_path / "out").rglob("*.csv"))) == 2000
    assert files.scan(spark, f"{tmp_path}/out", "n long", "key").where("key = n").count() == 2000


def test_keys_without_text_and_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([(None, 1), ("", 2), ("B", 3)], "key string, n int")
    files.export_by_key(rows, "key", f"{tmp_path}/out")
    assert sorted((r.key, r.n) for r in files.scan(spark, f"{tmp_path}/out", "n int", "key").collect()) == [("B", 3), (files.NO_KEY, 1), (files.NO_KEY, 2)]
    files.export_by_key(rows.limit(0), "key", f"{tmp_path}/none")
    assert files.scan(spark, f"{tmp_path}/none", "n int", "key").count() == 0


def test_a_try_that_breaks_off_leaves_no_file(tmp_path):
    def batches():
        yield files.pa.RecordBatch.from_pydict({"key": ["A", "B"], "line": [b"1", b"2"]})
        raise OSError("broke off")

    write = files._files_of(str(tmp_path), "key", b"n\n")
    with pytest.raises(OSError, match="broke off"):
        list(write(batches()))
    assert [x.name for x in tmp_path.rglob("*.csv")] == ["key=A.csv"]


@pytest.mark.parametrize("path, want", [("key=A%2520B/part-0.csv", "A B"), ("key=A%253AB.csv", "A:B"), ("A+B.csv.gz", "A+B"), ("key=F.csv/part-0.csv", "F.csv"), ("B%20B.csv", "B B"), ("key=/A.csv", "A")])
def test_key_of(spark, path, want):
    assert spark.range(1).select(files.key_of(files.F.lit(f"file:/x/{path}"), "key")).first()[0] == want
