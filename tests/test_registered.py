import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from reckon.sources import registered
from test_sources import book


def landed(folder, pages):
    """Pages as (cursor, next cursor, items)."""
    for cursor, then, items in pages:
        at = folder / f"cursor={cursor or '__HIVE_DEFAULT_PARTITION__'}"
        at.mkdir(parents=True, exist_ok=True)
        (at / "part.json").write_text(json.dumps({"data": {"rows": items}, "next": then}))


def follow(spark, folder, out, **options):
    stream = spark.readStream.format("cursor_pages").options(items="data.rows", next="next", **options).load(str(folder))
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-at").option("path", str(out)).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((r["page"], r["row"], r["cursor"], r["item"]) for r in spark.read.parquet(str(out)).collect())


def test_a_stream_over_cursors_gives_each_item_once(spark, tmp_path):
    registered.register(spark)
    pages = [("", "c1", [1, 2]), ("c1", "c2", [{"a": "é"}]), ("c2", "c3", []), ("c3", None, ["x"])]
    landed(tmp_path / "in", pages[:1])
    want = [(1, 1, "", "1"), (1, 2, "", "2"), (2, 1, "c1", '{"a": "é"}'), (4, 1, "c3", '"x"')]
    assert follow(spark, tmp_path / "in", tmp_path / "out") == want[:2]
    landed(tmp_path / "in", pages[1:2])
    assert follow(spark, tmp_path / "in", tmp_path / "out") == want[:3]
    assert follow(spark, tmp_path / "in", tmp_path / "out") == want[:3]  # page c2 has not landed
    landed(tmp_path / "in", pages[2:])
    for _ in range(2):  # the second time there is nothing more
        assert follow(spark, tmp_path / "in", tmp_path / "out") == want


@pytest.mark.parametrize("pages, options, said", [([("", "a", [1]), ("a", "b", [2]), ("b", "a", [3])], {}, "cursor a is repeated"), ([("", "a", []), ("a", "b", []), ("b", None, [])], {"maxPages": 2}, "more than 2 pages")])
def test_repeated_cursors_and_too_many_pages_fail(spark, tmp_path, pages, options, said):
    registered.register(spark)
    landed(tmp_path / "in", pages)
    with pytest.raises(StreamingQueryException, match=said):
        follow(spark, tmp_path / "in", tmp_path / "out", **options)


def test_workbook_source_opens_only_wanted_sheets(spark, tmp_path):
    registered.register(spark)
    row = '<row r="{0}"><c r="B{0}"><v>{1}</v></c></row>'
    for name in ("a", "b"):
        book(str(tmp_path / f"{name}.xlsx"), {"one": "".join(row.format(k, k * 10) for k in range(1, 6)), "two": row.format(3, 7)})
    (tmp_path / "c.txt").write_text("no workbook")
    sheets = spark.read.format("workbook").load(f"{tmp_path}/*.xlsx")
    assert sheets.count() == 12 and sheets.rdd.getNumPartitions() == 4
    one = sheets.where((F.col("sheet") == "one") & (F.col("row") > 3) & (F.col("file") == f"{tmp_path}/b.xlsx"))
    assert one.rdd.getNumPartitions() == 1 and sorted((r["row"], r["cells"]) for r in one.collect()) == [(4, [None, "40"]), (5, [None, "50"])]
    assert sorted((r["sheet"], r["row"]) for r in sheets.where("sheet in ('two', 'none') and row = 3").collect()) == [("two", 3)] * 2
    assert [r[0] for r in sheets.where("row < 2 and cells[1] = '10'").select("row").collect()] == [1, 1]


def test_many_small_books_share_partitions_and_large_ones_do_not(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registered, "BOOKS", 4, raising=False)
    row = '<row r="{0}"><c r="A{0}"><v>{1}</v></c></row>'
    names = [f"b{k}" for k in range(30)]
    for k, name in enumerate(names):
        book(str(tmp_path / f"{name}.xlsx"), {"one": row.format(1, k), "two": "".join(row.format(n, k * n) for n in range(1, 2000 if name == "b7" else 3))})
    opened, real = [], registered.xlsx.sheet_names
    monkeypatch.setattr(registered.xlsx, "sheet_names", lambda source: opened.append(1) or real(source))
    reader = registered.WorkbookReader({"path": f"{tmp_path}/*.xlsx"})
    parts = reader.partitions()
    assert len(parts) == 6 and len(opened) == 1  # both sheets of b7, and four of the others, which the driver does not open
    got = sorted((r[0].rsplit("/", 1)[-1], *r[1:3], *r[3]) for p in parts for r in reader.read(p))
    assert got == sorted((f"{n}.xlsx", s, r, str(k * r if s == "two" else k)) for k, n in enumerate(names) for s in ("one", "two") for r in range(1, 2 if s == "one" else 2000 if n == "b7" else 3))
    sheets = spark.read.format("workbook").load(f"{tmp_path}/*.xlsx")
    assert sheets.where("sheet = 'two' and row = 2").count() == 30 and sheets.where(F.col("file") == f"{tmp_path}/b3.xlsx").count() == 3
