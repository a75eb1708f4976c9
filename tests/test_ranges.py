import csv
import io
import json
import random

import pytest

from reckon.sources import files, ranges


def read(df, of):
    out = {}
    for r in df.orderBy("file", "row").collect():
        out.setdefault(r["file"].rsplit("/", 1)[-1], []).append((r["row"], of(r)))
    return out


@pytest.fixture(scope="module")
def delimited(tmp_path_factory):
    """Files of random quotes, commas and line ends of all kinds, with and without byte order marks, closed or not."""
    folder, want, draw = tmp_path_factory.mktemp("csv"), {}, random.Random(5)
    pool = ["a", '"', '"', '""', ",", "\n", "\r\n", "\r", "é", " ", "x" * 20, '",', '\n"', "1,2,3\n"]
    texts = ["".join(draw.choice(pool) for _ in range(n)) for n in (0, 1, 5, 40, 60, 400, 1500)]
    texts += ['a,b\n1,"x\ny', "".join(f'{i},"several\nlines {i} ""q"" {"z" * (i % 50)}",e\n' for i in range(150)), "one", "\n\n\n", '"']
    for k, text in enumerate(texts):
        data = (b"\xef\xbb\xbf" if k % 3 == 0 else b"") + text.encode()
        (folder / f"f{k}.csv").write_bytes(data)
        rows = list(csv.reader(io.TextIOWrapper(io.BytesIO(data), "utf-8-sig", newline="")))
        want |= {f"f{k}.csv": list(enumerate(rows, 1))} if rows else {}
    return str(folder), want


@pytest.mark.parametrize("size", [200, None])
def test_delimited_files_by_ranges_equal_the_csv_module(spark, delimited, size):
    folder, want = delimited
    assert read(ranges.delimited(spark, folder, range_bytes=size), lambda r: r["cells"]) == want


def test_other_separators_and_wide_cells(spark, tmp_path):
    wide = "w" * 300_000
    (tmp_path / "a.tsv").write_text(f'1\t"{wide}\t{wide}"\n2\ta,b\n')
    got = ranges.delimited(spark, str(tmp_path), "\t", 4096)
    assert [(r["row"], r["cells"]) for r in got.orderBy("row").collect()] == [(1, ["1", f"{wide}\t{wide}"]), (2, ["2", "a,b"])]


def test_numbers_of_kept_rows_by_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "NUMBERED", 7)
    (tmp_path / "a.csv").write_text("".join("Total,1\n" if k % 3 == 0 else f"{k},x\n" for k in range(100)))
    got = files.read_delimited(spark, str(tmp_path / "a.csv"), start_row=5).orderBy("row").collect()
    rows = [k + 1 for k in range(100) if k % 3 and k + 1 >= 5]
    assert [(r["row"], r["ordinal"]) for r in got] == [(row, n) for n, row in enumerate(rows, 5)]


@pytest.mark.parametrize("size", [200, None])
def test_json_arrays_by_ranges(spark, tmp_path, size):
    draw, want = random.Random(8), {}

    def value(depth):
        x = draw.random()
        if depth == 0 or x < 0.4:
            return draw.choice([1, 2.5, None, True, "a,b", 'q"u\\o[te', "[{", "é\\", "", " x ]"])
        if x < 0.7:
            return [value(depth - 1) for _ in range(draw.randrange(4))]
        return {draw.choice('abc,]"') + str(i): value(depth - 1) for i in range(draw.randrange(4))}

    for k, n in enumerate((0, 1, 3, 150, 60, 400)):
        items = [value(3) for _ in range(n)]
        text = json.dumps(items, indent=k % 3 or None, ensure_ascii=k % 2 == 0)
        (tmp_path / f"j{k}.json").write_text(("﻿" if k == 2 else "") + text + "\n" * (k % 2), "utf-8")
        want |= {f"j{k}.json": list(enumerate(items, 1))} if items else {}
    (tmp_path / "o.json").write_text('{"items": [1, "a"]}')
    items, others = ranges.json_items(spark, str(tmp_path), size)
    assert read(items, lambda r: json.loads(r["text"])) == want and [o.rsplit("/", 1)[-1] for o in others] == ["o.json"]
    got = read(files.read_json(spark, str(tmp_path), size), lambda r: r["cells"])
    assert got["o.json"] == [(1, ["1"]), (2, ["a"])]
    texts = {str: lambda v: v, bool: lambda v: "true", int: str, float: str}
    for name, rows in want.items():
        for (row, cells), (_, item) in zip(got[name], rows):
            assert cells == (None if item is None or isinstance(item, dict) else cells if isinstance(item, list) else [texts[type(item)](item)]), (name, row)


def test_dated_names_of_a_column(spark):
    from datetime import date

    from pyspark.sql import functions as F

    days = [date(2024, 2, 29), date(1999, 12, 31)]
    rows = spark.createDataFrame([(d,) for d in days], "d date")
    for template in ("P_{date:%Y%m%d}_*.csv", "{date:%d/%m/%y}", "none", "a{date:%j}b{date:x%Hy}"):
        got = [r[0] for r in rows.select(files.dated_names(template, F.col("d"))).collect()]
        assert got == [files.dated(template, d) for d in days]
    with pytest.raises(ValueError):
        files.dated_names("{date:%Q}", F.col("d"))


def test_small_ranges_grow_with_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "RANGES", 40, raising=False)
    rows = [[str(k), f'a,\n"{k}"'] for k in range(4000)]
    with open(tmp_path / "a.csv", "w", newline="") as out:
        csv.writer(out, lineterminator="\n").writerows(rows)
    (tmp_path / "a.json").write_text(json.dumps(rows))
    for name, separator in (("a.csv", "\n"), ("a.json", ",")):
        assert 30 <= ranges.pieces(spark, str(tmp_path / name), separator, 64).rdd.getNumPartitions() <= 41
    want = list(enumerate(rows, 1))
    assert read(ranges.delimited(spark, str(tmp_path / "a.csv"), range_bytes=64), lambda r: r["cells"]) == {"a.csv": want}
    assert read(ranges.json_items(spark, str(tmp_path / "a.json"), 64)[0], lambda r: json.loads(r["text"])) == {"a.json": want}


def test_ranges_are_no_larger_than_the_session_allows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2\n" * 20_000)
    own = spark.newSession()
    for said, bytes_ in (("100b", 100), ("250", 250), ("64k", 313), ("128MB", 313)):
        own.conf.set("spark.sql.files.maxPartitionBytes", said)
        assert ranges._grown(own, str(tmp_path / "a.csv"), 64) == bytes_
