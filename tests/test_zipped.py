"""CSV in ZIP archives: listing, heads, members of unlike columns, a round trip."""

import zipfile

import pytest

from tidemark.sources import readers
from tidemark.sources.zipped import read_zipped, write_zipped, zip_listing


@pytest.fixture()
def folder(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("in")
        z.writestr("in/one.csv", '﻿MMSI, lat,note\n1,2.5,"a ""b"", c\nd"\n2,,""\n')
        z.writestr("none.csv", "")
        z.writestr("note.txt", "MMSI\n9\n")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("two.CSV", "lat,more,MMSI\n7.5,x,3\n")
        z.writestr("head.csv", "MMSI,lat,note\n")
    return f"file://{tmp_path}"


def test_listing(spark, folder):
    got = sorted((r.archive, r.name, r.bytes, r.is_dir) for r in zip_listing(spark, folder).collect())
    assert [g[:2] + g[3:] for g in got] == [("a.zip", "in/", True), ("a.zip", "in/one.csv", False), ("a.zip", "none.csv", False), ("a.zip", "note.txt", False), ("b.zip", "head.csv", False), ("b.zip", "two.CSV", False)]
    assert dict((g[1], g[2]) for g in got)["none.csv"] == 0


def test_members_of_a_folder(spark, folder):
    df = read_zipped(spark, folder)
    assert df.columns == ["MMSI", "lat", "note"]
    assert sorted(map(tuple, df.collect()), key=str) == [("1", "2.5", 'a "b", c\nd'), ("2", None, ""), ("3", "7.5", None)]
    assert df.rdd.getNumPartitions() == 3
    one = read_zipped(spark, f"{folder}/b.zip", "two.CSV")
    assert one.columns == ["lat", "more", "MMSI"] and one.limit(1).first().more == "x"
    assert [tuple(r) for r in readers.typed(one, readers.POINT_COLUMNS).collect()] == [(3, 7.5)]


def test_no_csv_is_an_error(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("x.txt", "y")
    with pytest.raises(Exception, match="no CSV member"):
        read_zipped(spark, f"file://{tmp_path}")


def test_round_trip(spark, tmp_path):
    rows = [(k, None if k % 5 == 0 else f'x "{k}",\n', "" if k % 3 else "y") for k in range(500)]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    path = f"file://{tmp_path}/out"
    assert write_zipped(df.repartition(3), path) == 500
    assert write_zipped(df.where("k < 0"), path) == 0
    assert sorted((int(r.k), r.a, r.b) for r in read_zipped(spark, path).collect()) == rows
