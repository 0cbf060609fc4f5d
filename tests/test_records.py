"""Quoted records from byte ranges against the csv module."""

import csv
import io
import random
from contextlib import contextmanager

import pytest

from wayline.sources import files as L
from wayline.sources import records as R

SETTINGS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@contextmanager
def ranges(spark, size):
    """The length of the ranges that files are read in."""
    before = {k: spark.conf.get(k) for k in SETTINGS}
    spark.conf.set(SETTINGS[0], f"{size}b")
    spark.conf.set(SETTINGS[1], "1b")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(rng, n):
    """A random file as a csv writer makes it, and fields as nobody should write them."""
    value = lambda: "".join(rng.choice(["a", "b", ",", '"', "\n", "\r\n", " ", "é", "\\", "''"]) for _ in range(rng.randint(0, 6)))
    buffer, end = io.StringIO(), rng.choice(["\n", "\r\n"])
    writer = csv.writer(buffer, lineterminator=end, quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL, csv.QUOTE_NONNUMERIC]))
    for _ in range(n):
        if rng.random() < 0.15:
            buffer.write(rng.choice(['a"b,c"', '"x"y,z', '"x""y" "z",', ",", '""', ' "a, b"', '"a,""\n"",b"', ""]) + end)
        else:
            writer.writerow([value() for _ in range(rng.randint(1, 4))])
    return buffer.getvalue()


def read(spark, path, size=10**9):
    with ranges(spark, size):
        lines = R.numbered_lines(spark, str(path), "*.csv")
    found = R.records(lines)
    rows = found.select("file", "record", R.fields(found["text"]).alias("f")).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r["record"]):
        out.setdefault(r["file"].rsplit("/", 1)[-1], []).append(list(r["f"]))
    return out


@pytest.mark.parametrize("size", [1, 9, 10**9])
def test_like_the_csv_module(spark, tmp_path, size):
    rng, want = random.Random(8), {}
    for i in range({1: 2, 9: 6}.get(size, 20)):
        text = written(rng, 12 if size == 1 else 30)
        (tmp_path / f"{i}.csv").write_text(text, encoding="utf-8", newline="")
        want[f"{i}.csv"] = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    assert read(spark, tmp_path, size) == want


def test_a_quote_that_is_never_closed(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text('a,b\n1,"2\n3,4\n5,6')
    assert read(spark, tmp_path) == {"a.csv": [["a", "b"], ["1", "2\n3,4\n5,6"]]}
    monkeypatch.setattr(R, "MOST_LINES", 2)
    found = {(r["record"], r["text"], r["lines"]) for r in R.records(R.numbered_lines(spark, str(tmp_path))).collect()}
    assert found == {(0, "a,b", 1), (1, None, 3)}


def test_long_quoted_fields_and_wide_lines(spark, tmp_path):
    long, wide = '""' * 60_000, ",".join(f'"{i}"' for i in range(20_000))
    (tmp_path / "a.csv").write_text(f'"{long}\n{long}",x\n{wide}\n')
    got = read(spark, tmp_path)["a.csv"]
    assert got[0] == ['"' * 60_000 + "\n" + '"' * 60_000, "x"] and got[1] == [str(i) for i in range(20_000)]


def test_rows_by_their_headers(spark, tmp_path):
    for feed, text in (("a", '﻿stop_id, stop_name,extra\r\n1,"Main\nStreet",x\r\n\r\n2,"say ""hi"""\r\n'), ("b", 'stop_name,stop_id\n,3\n'), ("c", "")):
        (tmp_path / f"feed={feed}").mkdir()
        (tmp_path / f"feed={feed}" / "stops.txt").write_text(text, encoding="utf-8", newline="")
    got = {tuple(r) for r in L.gtfs_folder(spark, str(tmp_path), "stops").select("feed", "row_ix", "stop_id", "stop_name").collect()}
    assert got == {("a", 0, "1", "Main\nStreet"), ("a", 1, "2", 'say "hi"'), ("b", 0, "3", None)}
    assert L.gtfs_folder(spark, str(tmp_path), "stops", "nothing.txt").count() == 0


def test_headers_are_carried_with_the_rows(spark):
    records = [("a", 1, "x,y", 1), ("a", 2, "1,2", 1), ("a", 1_000_000, None, 5), ("a", 1_000_003, "3,4", 2), ("a", 3_000_000, '"5",', 1), ("b", 0, "y, x ,x", 1), ("b", 9, "1,2,3", 1), ("c", 0, None, 9), ("d", 0, "x", 1)]
    rows = R.headed_rows(spark.createDataFrame(records, "file string, record bigint, text string, lines bigint"), ["x", "y", "z"])
    want = {("a", 0, "1", "2", None), ("a", 1, "3", "4", None), ("a", 2, "5", None, None), ("b", 0, "3", "1", None)}
    assert {tuple(r) for r in rows.collect()} == want

    def nodes(node):
        yield node
        for i in range(node.children().size()):
            yield from nodes(node.children().apply(i))

    plan = list(nodes(rows._jdf.queryExecution().optimizedPlan()))
    dealt = [[a.split("#")[0] for a in n.output().mkString(" ").split()] for n in plan if n.nodeName() == "RepartitionByExpression"]
    # records are used by the scan alone, whose two uses deal the same columns and so share one exchange
    assert sum(n.children().size() == 0 for n in plan) == 2 and len(dealt) == 2 and dealt[0] == dealt[1] and "lines" not in dealt[0]
