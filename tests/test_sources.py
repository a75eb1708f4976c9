import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from reckon.operators import mapping
from reckon.sources import files, raw_rows, read_rows
from reckon.streaming import ingest


def cells(rows):
    return [(r["row"], r["ordinal"], r["cells"]) for r in rows.orderBy("row").collect()]


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('ID,Note\n1,"x\ny"\n\n2,Thành công\nGrand Total,5\n3,z\n', "utf-8")
    assert cells(read_rows(spark, str(path), 2)) == [(2, 2, ["1", "x\ny"]), (4, 3, ["2", "Thành công"]), (6, 4, ["3", "z"])]
    (tmp_path / "b.tsv").write_text("1\t2\n")
    assert cells(read_rows(spark, str(tmp_path / "b.tsv"))) == [(1, 1, ["1", "2"])]
    with pytest.raises(ValueError):
        read_rows(spark, "a.txt")


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([["a", 1.5, None], "b", {"k": 2.0, "m": "x"}], indent=1))
    got = read_rows(spark, str(tmp_path / "a.json")).orderBy("row").collect()
    assert [r["cells"] for r in got] == [["a", "1.5", None], ["b"], None] and got[2]["record"] == {"k": "2.0", "m": "x"}
    (tmp_path / "b.json").write_text('{"items": [{"a": 1}, {"b": 2}]}')
    assert files.json_headers(read_rows(spark, str(tmp_path / "b.json"))) == ["a", "b"]


def book(path, sheets):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    link = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {main} {link}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>shared</t></si></sst>")
        for k, body in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")


def test_xlsx(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    body = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>3</v></c></row><row r="3"><c r="A3"><v>1.5</v></c><c r="D3" t="inlineStr"><is><t>total</t></is></c></row><row r="4"><c r="B4" t="inlineStr"><is><t>Total</t></is></c></row>'
    book(path, {"one": body, "two": '<row r="1"><c r="A1"><v>7.0</v></c></row>'})
    assert cells(read_rows(spark, path)) == [(2, 1, ["shared", None, "3"]), (3, 2, ["1.5", None, None, "total"])]
    assert cells(read_rows(spark, path, sheet="two")) == [(1, 1, ["7"])]
    assert cells(read_rows(spark, path, sheet="none"))[0][0] == 2


def test_raw_rows_and_structures(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",\nId, Note \n1,x\n,\nTotal,5\n2,y\n", "utf-8")
    rows = raw_rows(spark, str(tmp_path / "a.csv"))
    assert [(r["row"], r["ordinal"], r["cells"]) for r in files.preview(rows, 4).orderBy("row").collect()] == [(2, 1, ["Id", "Note"]), (3, 2, ["1", "x"]), (4, 3, ["", ""]), (5, 4, ["Total", "5"])]
    assert [r["cells"] for r in files.row_at(rows, 4).collect()] == [["Total", "5"]] and files.row_at(rows, 9).count() == 0
    shape = files.structures(rows).first()
    assert (shape["headers"], shape["columns"], shape["header_row"], shape["first_data_row"], shape["signature"]) == (["Id", "Note"], 2, 2, 3, files.signature(["Id", "Note"], 2))
    (tmp_path / "b.json").write_text('[{"a": 1, "c": "é"}, {"b": 2, "a": 3}]', "utf-8")
    shape = files.structures(raw_rows(spark, str(tmp_path / "b.json"))).first()
    assert shape["headers"] == ["a", "c", "b"] and shape["signature"] == files.signature(["a", "c", "b"], 3)


def test_workbook_dates(spark, tmp_path):
    path = str(tmp_path / "d.xlsx")
    cells_ = "".join(f'<c r="{c}1" s="{s}"><v>{v}</v></c>' for c, s, v in (("A", 1, "45292.5"), ("B", 0, "45292.5"), ("C", 2, "45292"), ("D", 3, "0.25"), ("E", 4, "7"), ("F", 1, "59"), ("G", 1, "61")))
    book(path, {"one": f'<row r="1">{cells_}</row>'})
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/><numFmt numFmtId="165" formatCode="0.0 &quot;days&quot; [Red]"/></numFmts>'
                   '<cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="164"/><xf numFmtId="20"/><xf numFmtId="165"/></cellXfs></styleSheet>')
    assert cells(read_rows(spark, path))[0][2] == ["2024-01-01 12:00:00", "45292.5", "2024-01-01 00:00:00", "06:00:00", "7", "1900-02-28 00:00:00", "1900-03-01 00:00:00"]


def test_staging_is_idempotent(spark):
    kind = "unit string, stage string, page int, created_at int, body string"
    pages = spark.createDataFrame([("u1", "s", 1, 1, "a"), ("u1", "s", 1, 2, "b"), ("u2", "s", 2, 1, "c")], kind)
    first = files.staged(pages, pages.limit(0))
    assert sorted((r["unit"], r["body"], r["status"]) for r in first.collect()) == [("u1", "a", "STAGED"), ("u2", "c", "STAGED")]
    assert files.staged(pages, first).count() == 0
    done = files.consumed(first, pages.where("unit = 'u1'"))
    assert sorted((r["unit"], r["status"]) for r in files.for_replay(done, "s").collect()) == [("u1", "CONSUMED"), ("u2", "STAGED")] and files.for_replay(done, "t").count() == 0


def test_batches_by_day_read_only_their_days(spark, tmp_path):
    target, kind = str(tmp_path / "days"), "k string, day int, ordinal int"
    one = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 2, 3)], kind)
    got = ingest.append_batch(one, 0, target, ["k", "day"], by="day")
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, 2, 1, 1), ("b", 2, 1, 1, 0)]
    two = spark.createDataFrame([("a", 1, 4), ("c", 1, 5)], kind)
    for _ in range(2):
        got = ingest.append_batch(two, 1, target, ["k", "day"], by="day")
        assert sorted(tuple(r) for r in got.collect()) == [("a", 1, 1, 0, 1), ("c", 1, 1, 1, 0)]
    assert sorted((r["k"], r["day"], r["ordinal"]) for r in ingest.stored_rows(spark, target, one.schema).collect()) == [("a", 1, 1), ("b", 2, 3), ("c", 1, 5)]


def test_discovery_and_signature(spark, tmp_path):
    for n in ("P_20260810_b.csv", "P_20260810_a.csv", "P_20260811_a.csv"):
        (tmp_path / n).write_text("x")
    got = files.dropped_files(spark, str(tmp_path), "P_{date:%Y%m%d}_*.csv", date(2026, 8, 10), 0.1)
    assert [g.rsplit("/", 1)[-1] for g in got] == ["P_20260810_a.csv", "P_20260810_b.csv"]
    assert files.signature(["a"], 1) != files.signature(["a"], 2)


def test_staged_pages(spark):
    pages = spark.createDataFrame([(1, 1, '{"cursorAfter":"x","items":[{"id":"a"}]}'), (1, 2, '{"cursorAfter":"x","items":[{"id":"b"},{"id":"c"}]}'), (2, 1, '{"items":[{"id":"d"}]}')], "page int, created_at int, body string")
    assert [r["record"]["id"] for r in files.staged_items(pages).orderBy("page", "row").collect()] == ["b", "c", "d"]
    files.check_cursors(pages)
    with pytest.raises(ValueError):
        files.check_cursors(pages.withColumn("page", F.col("page") + F.col("created_at")))


def test_stream_is_idempotent(spark, tmp_path):
    drop, target = tmp_path / "drop", str(tmp_path / "rows")
    drop.mkdir()
    (drop / "1.csv").write_text("a,1\nb,2\na,3\n")
    fields = [mapping.FieldMapping("id", column=1, required=True)]

    def prepare(batch):
        rows = batch.select(F.split("value", ",").alias("cells"), F.xxhash64("value").alias("ordinal"))
        return mapping.map_rows(rows, fields).select("id", F.get("cells", F.lit(1)).cast("int").alias("ordinal"))

    def go():
        ingest.ingest(spark.readStream.text(str(drop)), prepare, target, str(tmp_path / "checkpoint"), ["id"]).awaitTermination()
        return sorted((r["id"], r["ordinal"]) for r in spark.read.parquet(target).collect())

    assert go() == [("a", 1), ("b", 2)]
    (drop / "2.csv").write_text("b,9\nc,4\n")
    assert go() == [("a", 1), ("b", 2), ("c", 4)] == go()
    again = spark.createDataFrame([("b", 9), ("c", 4)], "id string, ordinal int")
    ingest.append_batch(again, 1, target, ["id"])  # a repeated batch
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]
