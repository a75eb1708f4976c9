"""Registered queries of landed files, staged pages, streams, mapping rules and scope defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import keys, text
from ..operators import mapping, match, metrics, recovery, scope
from ..session import shared_path, ship
from ..sources import files, registered
from ..streaming import ingest
from . import catalog, workload
from .catalog import FULL, query
from .workload import RELATIONS, table

# Files. The parts are landed once a query as the files that a partner would drop.


def _in_one(lines: DataFrame) -> DataFrame:
    """Lines made in parallel, in the order of their parts for one task to write: one file has one writer."""
    return lines.repartitionByRange(1, "p_partkey").sortWithinPartitions("p_partkey")


def _landed(spark: SparkSession, d: str, one_file: bool = False) -> str:
    """The parts table as files of CSV lines: quoted cells that hold line ends, blank rows and summary rows."""
    ship(spark)
    path = shared_path(spark, "landed")
    k = F.col("p_partkey")
    name = F.concat(F.lit('"'), F.regexp_replace("p_name", '"', '""'), F.lit(',\n""x"""'))
    line = F.when(k % 10 == 0, ",, ").when(k % 10 == 1, F.concat(F.lit("Grand Total,"), k.cast("string"))).otherwise(F.concat_ws(",", k.cast("string"), name, F.lit("")))
    lines = table(spark, d, "part").select("p_partkey", line.alias("value"))
    lines = _in_one(lines) if one_file else lines
    lines.select("value").write.text(path)
    return f"{path}/*.txt"


@query("""SELECT p_partkey AS key, p_name || ',' || chr(10) || '"x"' AS name, 3 AS cells FROM part WHERE p_partkey % 10 NOT IN (0, 1)""")
def source_delimited(spark, d):
    rows = files.read_delimited(spark, _landed(spark, d))
    return rows.select(F.get("cells", F.lit(0)).cast("long").alias("key"), F.get("cells", F.lit(1)).alias("name"), F.size("cells").alias("cells"))


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS row FROM part), k AS (SELECT * FROM r WHERE p_partkey % 10 NOT IN (0, 1))
SELECT row, row_number() OVER (ORDER BY p_partkey) AS ordinal, p_partkey AS key, p_name || ',' || chr(10) || '"x"' AS name FROM k""")
def source_delimited_ranges(spark, d):
    """One file read by ranges of a kilobyte or more, most of which begin or end inside of a quoted cell."""
    rows = files.kept(files.delimited(spark, _landed(spark, d, one_file=True), range_bytes=1024), 1)
    return rows.select("row", "ordinal", F.get("cells", F.lit(0)).cast("long").alias("key"), F.get("cells", F.lit(1)).alias("name"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey % 10 = 0) AS blank, count(*) FILTER (WHERE p_partkey % 10 = 1) AS summaries FROM part""")
def source_raw(spark, d):
    rows = files.delimited(spark, _landed(spark, d))
    first = F.get("cells", F.lit(0))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.trim(first) == "").alias("blank"), F.count_if(text.holds_summary_word(F.col("cells"))).alias("summaries"))


@query("""SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS name, CASE WHEN p_partkey % 2 = 1 THEN CAST(p_size AS VARCHAR) END AS size FROM part""")
def source_json(spark, d):
    path = shared_path(spark, "landed-json")
    k = F.col("p_partkey")
    body = F.when(k % 2 == 0, F.to_json(F.struct("p_partkey", "p_name"))).otherwise(F.to_json(F.struct("p_partkey", "p_size")))
    page = table(spark, d, "part").groupBy(F.floor(k / 100).alias("page")).agg(F.array_join(F.collect_list(body), ",").alias("items"))  # of a hundred records
    page.select(F.concat(F.lit('{"items": ['), "items", F.lit("]}")).alias("value"), "page").write.partitionBy("page").text(path)
    rows = files.read_json(spark, f"{path}/*")
    record = F.col("record")
    return rows.select(record["p_partkey"].cast("long").alias("key"), record["p_name"].alias("name"), record["p_size"].alias("size"))


@query("""SELECT row_number() OVER (ORDER BY p_partkey) AS row, p_partkey AS key, 'a]"' || p_name || '\\,[{' AS name, p_size AS size FROM part""")
def source_json_array(spark, d):
    """One array of all parts read by ranges of a kilobyte or more; texts hold brackets, commas, quotes and backslashes."""
    path = shared_path(spark, "landed-array")
    name = F.concat(F.lit('a]"'), F.col("p_name"), F.lit("\\,[{"))
    body = F.to_json(F.struct("p_partkey", name.alias("p_name"), F.struct(F.array("p_size").alias("sizes")).alias("inner")))
    parts = table(spark, d, "part")
    edge = parts.agg(F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last"))  # a row
    line = F.concat(F.when(F.col("p_partkey") == F.col("first"), "[").otherwise(""), body, F.when(F.col("p_partkey") == F.col("last"), "]").otherwise(","))
    _in_one(parts.join(F.broadcast(edge)).select("p_partkey", line.alias("value"))).select("value").write.text(path)
    rows = files.read_json(spark, f"{path}/*.txt", range_bytes=1024)
    record = F.col("record")
    return rows.select("row", record["p_partkey"].cast("long").alias("key"), record["p_name"].alias("name"), F.get_json_object(record["inner"], "$.sizes[0]").cast("int").alias("size"))


@query("""WITH b AS (SELECT p_brand AS brand, CAST(regexp_extract(p_brand, '[0-9]+$') AS INTEGER) % 3 AS kind, min(p_partkey) AS first FROM part GROUP BY ALL)
SELECT brand, CAST(len(h) AS INTEGER) AS columns, h[1] AS first_header, md5('[[' || array_to_string(list_transform(h, lambda x: '"' || x || '"'), ', ') || '], ' || len(h) || ']') AS signature, first AS first_key
FROM (SELECT *, CASE kind WHEN 0 THEN ['Id', 'Name'] WHEN 1 THEN ['Id', 'Name', 'Size'] ELSE ['Mã số', 'Name'] END AS h FROM b)""")
def source_structures(spark, d):
    """A file for each brand behind a blank line: its headers, the signature that files of one structure share, and the first row by number."""
    path = shared_path(spark, "brands")
    digits = F.regexp_extract("p_brand", "[0-9]+$", 0).cast("int") % 3
    heads = F.element_at(F.array(*[F.lit(h) for h in ("Id,Name", "Id,Name,Size", "Mã số,Name")]), digits + 1)
    line = F.concat_ws(",", "p_partkey", "p_type", F.when(digits == 1, F.col("p_size").cast("string")))
    rows = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("at"), line.alias("value"))
    brands = table(spark, d, "part").select("p_brand", heads.alias("heads")).distinct()
    top = brands.select("p_brand", F.posexplode(F.array(F.lit(","), "heads")).alias("at", "value")).withColumn("at", F.col("at").cast("long") - 10)
    rows.unionByName(top).repartition("p_brand").sortWithinPartitions("p_brand", "at").drop("at").write.partitionBy("p_brand").text(path)
    raw = files.delimited(spark, f"{path}/*")
    brand = F.url_decode(F.url_decode(F.regexp_extract("file", "p_brand=([^/]*)", 1))).alias("brand")  # escaped in the folder, and again in its URI
    shapes = files.structures(raw).select(brand, "columns", F.col("headers")[0].alias("first_header"), "signature")
    return shapes.join(files.row_at(raw, 2).select(brand, F.col("cells")[0].cast("long").alias("first_key")), "brand")


_PAGES = """
g AS (SELECT event_id // 20 AS page, event_id // 2000 AS stage, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY ALL)"""


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Staged pages of twenty events: unit, stage, page, created_at, body; every third page comes twice."""
    k = F.col("event_id")
    item = F.to_json(F.struct(k.cast("string").alias("id"), F.col("event_type").alias("kind")))
    page = table(spark, d, "events").groupBy(F.floor(k / 2000).alias("stage"), F.floor(k / 20).alias("page")).agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("items"))
    body = F.concat(F.lit('{"data": {"items": ['), F.col("items"), F.lit("]}}"))
    times = F.explode(F.when(F.col("page") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return page.select(F.concat(F.lit("u"), F.col("page").cast("string")).alias("unit"), F.col("stage").cast("string").alias("stage"), "page", times.alias("created_at"), body.alias("body"))


@query("""WITH p AS (SELECT event_id // 2000 AS stage, event_id // 20 AS page, count(*) AS items FROM events GROUP BY ALL)
SELECT CAST(stage AS VARCHAR) AS stage, CASE WHEN page % 4 = 0 THEN 'CONSUMED' ELSE 'STAGED' END AS status, count(*) AS pages, CAST(sum(items) AS BIGINT) AS items FROM p WHERE page % 5 <> 0 GROUP BY ALL""")
def staged_pages(spark, d):
    every = pages(spark, d)
    fresh = files.staged(every, every.where("page % 5 = 0"))
    marked = files.consumed(fresh, every.where("page % 4 = 0"))
    counted = F.sum(F.json_array_length(F.get_json_object("body", "$.data.items"))).cast("long").alias("items")
    return files.for_replay(marked).groupBy("stage", "status").agg(F.count("*").alias("pages"), counted)


@query("""SELECT event_id // 20 AS page, CAST(event_id AS VARCHAR) AS id, event_type AS kind FROM events""")
def staged_replay(spark, d):
    every = pages(spark, d)
    kept = files.for_replay(files.staged(every, every.limit(0)))
    return files.staged_items(kept, "$.data.items").select("page", F.col("record")["id"].alias("id"), F.col("record")["kind"].alias("kind"))


_CURSORS = 80


@query(f"""WITH e AS (SELECT event_id, event_type, event_id * {_CURSORS} // (SELECT max(event_id) + 1 FROM events) AS part FROM events)
SELECT CAST(part + 1 AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY part ORDER BY event_id) AS INTEGER) AS row, event_id AS id, event_type AS kind FROM e""")
def cursor_pages(spark, d):
    """Events landed as eighty pages that each name the next one's cursor, half of them first: two runs of a stream give each item once."""
    registered.register(spark)
    path, sink = shared_path(spark, "pages"), shared_path(spark, "items")
    ends = table(spark, d, "events").agg((F.max("event_id") + 1).alias("end"))  # a row
    e = table(spark, d, "events").join(F.broadcast(ends)).withColumn("part", F.floor(F.col("event_id") * _CURSORS / F.col("end")))
    item = F.struct("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("body"))
    page = e.groupBy("part").agg(F.array_sort(F.collect_list(item)).alias("items"))
    name = lambda part: F.concat(F.lit("c"), part.cast("string"))
    then = F.when(F.col("part") < _CURSORS - 1, F.concat(F.lit('"'), name(F.col("part") + 1), F.lit('"'))).otherwise("null")
    body = F.concat(F.lit('{"cursorAfter": '), then, F.lit(', "items": ['), F.array_join(F.transform("items", lambda i: i["body"]), ","), F.lit("]}"))
    pages_ = page.select(F.when(F.col("part") > 0, name(F.col("part"))).alias("cursor"), body.alias("value"), "part")
    for half in (F.col("part") < _CURSORS // 2, F.col("part") >= _CURSORS // 2):
        pages_.where(half).drop("part").write.mode("append").partitionBy("cursor").text(path)
        stream = spark.readStream.format("cursor_pages").load(path).writeStream.format("parquet").option("checkpointLocation", f"{sink}-at").option("path", sink)
        stream.trigger(availableNow=True).start().awaitTermination()
    item = F.from_json("item", "id long, kind string")
    return spark.read.parquet(sink).select("page", "row", item["id"].alias("id"), item["kind"].alias("kind"))


@query("""SELECT p_partkey AS key, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN p_size END AS size FROM part WHERE p_partkey % 3 <> 2""")
def source_workbook(spark, d):
    """Workbooks of the parts, a hundred a book and three sheets in each, of which two are read; strings are shared or inline, numbers are numbers."""
    registered.register(spark)
    path = f"{shared_path(spark, 'books')}"
    spark.createDataFrame([], "x string").write.text(path)  # makes the folder where all tasks write
    parts = table(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size")).alias("size"), F.floor(F.col("p_partkey") / 100).alias("book"))
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "book")  # a book is work, few bytes as it has: by bytes, few tasks would write all
    written = parts.groupBy("book").applyInPandas(lambda rows: registered.written_book(rows, path, ["p_partkey", "p_name", "size"], rows["p_partkey"] % 3), "file string")
    written.count()
    rows = spark.read.format("workbook").load(f"{path}/*.xlsx").where(F.col("sheet").isin("s0", "s1") & (F.col("row") > 1))
    return rows.select(F.col("cells")[0].cast("long").alias("key"), F.col("cells")[1].alias("name"), F.get("cells", F.lit(2)).cast("int").alias("size"))


# Writes and streams


@query("""SELECT user_id, CAST(ts AS DATE) AS day, min(event_id) AS event_id FROM events WHERE user_id IS NOT NULL GROUP BY ALL""")
def stream_first_writer(spark, d):
    """Two batches of events, the second repeated as after a failure: each key is stored once, by its first writer."""
    target = shared_path(spark, "ingested")
    e = table(spark, d, "events").where("user_id IS NOT NULL").select("user_id", F.to_date("ts").alias("day"), "event_id")
    late = table(spark, d, "events").agg(F.expr("max(event_id) div 2").alias("_half"))  # a row
    halves = e.join(F.broadcast(late), F.lit(True))
    batches = [halves.where("event_id <= _half").drop("_half"), halves.where("event_id > _half").drop("_half")]
    for n in (0, 1, 1):
        ingest.append_batch(batches[n], n, target, ["user_id", "day"], "event_id", by="day")
    return ingest.stored_rows(spark, target, e.schema).select("user_id", "day", "event_id")


_BATCHES = """WITH e AS (SELECT user_id, CASE WHEN event_id % 40 <> 7 THEN CAST(ts AS DATE) END AS day, event_id, event_type = 'error' AS bad, event_id * 6 // (SELECT max(event_id) + 1 FROM events) AS part FROM events),
b AS (SELECT * FROM e UNION ALL SELECT user_id, day, event_id, bad, part + 1 FROM e WHERE part < 5)"""


def event_batches(spark: SparkSession, d: str) -> list[DataFrame]:
    """Six batches of events, each with the rows of the one before once more; every fortieth row has no day."""
    ends = table(spark, d, "events").agg((F.max("event_id") + 1).alias("end"))  # a row
    day = F.when(F.col("event_id") % 40 != 7, F.to_date("ts"))
    rows = table(spark, d, "events").join(F.broadcast(ends)).select("user_id", day.alias("day"), "event_id", (F.col("event_type") == "error").alias("bad"), F.floor(F.col("event_id") * 6 / F.col("end")).alias("part"))
    return [rows.where(F.col("part").isin(n, n - 1)).drop("part") for n in range(6)]


@query(_BATCHES + " SELECT user_id, day, min(event_id) AS event_id, min_by(part, event_id) AS batch FROM e GROUP BY ALL")
def ingest_batches(spark, d):
    """Batches by day: a key is stored once, by its first writer, in the first batch that has it; so are those without a day."""
    target = shared_path(spark, "ingested")
    batches = event_batches(spark, d)
    for n, rows in enumerate(batches):
        ingest.append(rows, n, target, ["user_id", "day"], "event_id", by="day")
    return ingest.stored_rows(spark, target, batches[0].schema).select("user_id", "day", "event_id", "batch")


@query(_BATCHES + """, f AS (SELECT user_id, day, min(part) AS part FROM b WHERE NOT bad GROUP BY ALL), n AS (SELECT part, count(*) AS inserted FROM f GROUP BY ALL)
SELECT b.part AS batch, count(*) AS input, count(*) FILTER (WHERE bad) AS failed, coalesce(any_value(inserted), 0) AS inserted, count(*) FILTER (WHERE NOT bad) - coalesce(any_value(inserted), 0) AS repeated
FROM b LEFT JOIN n ON b.part = n.part GROUP BY b.part""")
def ingest_counters(spark, d):
    """The counts of each batch as its own write observes them; events of errors are not valid."""
    target = shared_path(spark, "ingested")
    counts = [(n, *ingest.append(rows, n, target, ["user_id", "day"], "event_id", valid=~F.col("bad")).values()) for n, rows in enumerate(event_batches(spark, d))]
    return spark.createDataFrame(counts, "batch long, input long, failed long, inserted long, repeated long")  # a row a batch


@query(FULL + " SELECT partner, date, reconciliation_status, count(*) AS n FROM results WHERE partner IS NOT NULL GROUP BY ALL")
def results_replaced(spark, d):
    """Results written twice, the second run for one partner: the read-back holds every outcome once."""
    path = shared_path(spark, "results")
    rows = catalog.results(spark, d).where("partner IS NOT NULL").select("partner", "date", "reconciliation_key", "reconciliation_status")
    match.write_results(rows, path)
    match.write_results(rows.where("partner = 'BUILDING'"), path)
    back = spark.read.schema("reconciliation_key string, reconciliation_status string, partner string, date date").parquet(path)
    return back.groupBy("partner", "date", "reconciliation_status").agg(F.count("*").alias("n"))


@query(FULL + """ SELECT partner, date, reconciliation_key, reconciliation_status, partner_record_id, internal_record_id,
row_number() OVER (ORDER BY reconciliation_key NULLS LAST, partner_record_id NULLS LAST, internal_record_id NULLS LAST, date, partner_ids) AS place FROM results WHERE partner = 'BUILDING' AND source_file_id = 'F3'""")
def results_ordered(spark, d):
    """Results of a partner's file, each with its place in the order."""
    rows = catalog.results(spark, d).where((F.col("partner") == "BUILDING") & (F.col("source_file_id") == "F3"))
    ids = F.array_join("ambiguous_partner_record_ids", ",").alias("ids")
    rows = rows.select("partner", "date", "reconciliation_key", "reconciliation_status", "partner_record_id", "internal_record_id", ids)
    return metrics.placed(rows, ["reconciliation_key", "partner_record_id", "internal_record_id", "date", "ids"]).drop("ids")


# Mapping


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'E' || event_id END AS id, CAST(event_id % 100 AS DECIMAL(20,4)) AS amount, event_type AS kind, 'v' || event_id % 7 AS inner_value,
CASE WHEN event_id % 3 = 0 THEN 'MALFORMED_ROW' ELSE '' END AS errors FROM events""")
def map_object_keys(spark, d):
    """Records keyed by letters and numbers, read by column numbers; a path ``a.b`` nests."""
    k = F.col("event_id")
    full = {"A": F.concat(F.lit("E"), k.cast("string")), "2": (k % 100).cast("string"), "kind": F.col("event_type"), "deep": F.concat(F.lit("v"), (k % 7).cast("string"))}
    every = F.create_map(*[x for name, v in full.items() for x in (F.lit(name), v)])
    record = F.when(k % 3 == 0, F.map_filter(every, lambda name, v: name != "A")).otherwise(every)
    maps = [
        mapping.FieldMapping("id", column=1, required=True), mapping.FieldMapping("amount", "DECIMAL", column="02", required=True), mapping.FieldMapping("currency", "CONSTANT", constant="VND"),
        mapping.FieldMapping("status", "CONSTANT", constant="SUCCESS"), mapping.FieldMapping("extra.kind", source_field="kind"), mapping.FieldMapping("note.deep", source_field="deep"),
    ]
    rows = mapping.map_rows(table(spark, d, "events").withColumn("record", record), maps, None, "record")
    errors = F.array_join(F.transform("errors", lambda e: e["code"]), ",")
    return rows.select("event_id", "id", "amount", F.col("extra")["kind"].alias("kind"), F.col("nested")["note"]["deep"].alias("inner_value"), errors.alias("errors"))


@query("""SELECT event_id % 6 AS form, count(*) AS n, count(*) FILTER (WHERE event_id % 6 IN (0, 1, 3)) AS exact FROM events GROUP BY 1""")
def amount_places(spark, d):
    """Amounts of more places than are stored are errors, not rounded; trailing zeros are no places."""
    k = F.col("event_id")
    forms = (".5", ".123400000", ".12345", "", "e-9x", ".00001")
    raw = F.concat((k % 1000).cast("string"), F.element_at(F.array(*map(F.lit, forms)), (k % 6 + 1).cast("int")))
    rows = table(spark, d, "events").select((k % 6).alias("form"), keys.exact_money(raw).alias("amount"))
    return rows.groupBy("form").agg(F.count("*").alias("n"), F.count("amount").alias("exact"))


@query("""SELECT CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 8 = 0 THEN NULL ELSE 'T' || event_id % 50 END ELSE 'E' || event_id % 90 END AS key, count(*) AS n FROM events GROUP BY 1""")
def ingestion_keys(spark, d):
    k = F.col("event_id")
    ident = F.when(k % 4 != 0, F.concat(F.lit("E"), (k % 90).cast("string"))).otherwise("")
    trace = F.when(k % 8 != 0, F.concat(F.lit("T"), (k % 50).cast("string"))).when(k % 16 == 0, "")
    return table(spark, d, "events").groupBy(keys.ingestion_key(ident, trace).alias("key")).agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n, count(DISTINCT (event_id % 40, event_type, event_id % 3, CASE WHEN event_id % 5 = 0 THEN -1 ELSE event_id % 2 END)) AS payloads FROM events""")
def payload_fingerprints(spark, d):
    """Equal payloads in unlike spellings: trailing zeros, the order of metadata, empty and missing metadata."""
    k = F.col("event_id")
    zeros = F.when(k % 7 < 3, "").otherwise(".000")
    amount = F.concat((k % 40).cast("string"), zeros).cast("decimal(20,8)")
    two = (k % 2).cast("string")
    spelled = F.when(k % 7 < 3, F.create_map(F.lit("a"), two, F.lit("b"), F.lit("1.50"))).otherwise(F.create_map(F.lit("b"), F.lit("1.5"), F.lit("a"), two))
    metadata = F.when(k % 5 != 0, spelled).when(k % 10 == 0, F.create_map().cast("map<string,string>"))
    at = F.timestamp_add("DAY", (k % 3).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    shown = keys.payload_fingerprint(F.when(k % 7 < 3, ""), F.col("event_type"), F.lit("SUCCESS"), amount, F.lit("VND"), at, metadata)
    return table(spark, d, "events").select(shown.alias("f")).agg(F.count("*").alias("n"), F.count_distinct("f").alias("payloads"))


@query("""SELECT count(*) AS n, count(DISTINCT (coalesce(CAST(user_id AS VARCHAR), ''), event_type, event_id % 9)) AS hashes FROM events""")
def row_hashes(spark, d):
    cells = F.array(F.col("user_id").cast("string"), F.col("event_type"), (F.col("event_id") % 9).cast("string"))
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.count_distinct(keys.row_hash(cells)).alias("hashes"))


def configurations(spark: SparkSession, d: str) -> DataFrame:
    """A configuration for each customer, a row a mapping; most have something wrong."""
    k = F.col("c_custkey")

    def one(position, path, type_, column=None, source=None, constant=None, pairs=0):
        of = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
        return F.struct(of(position, "int").alias("position"), of(path, "string").alias("path"), of(type_, "string").alias("type"), of(column, "string").alias("column"), of(source, "string").alias("source_field"), of(constant, "string").alias("constant"), of(pairs, "int").alias("pairs"))

    maps = F.array(
        one(1, "id", "STRING", F.when(k % 7 == 0, "A1").otherwise(mapping.letters_of(k % 3 + 1))),
        one(2, F.when(k % 5 == 0, "id").otherwise("amount"), "DECIMAL", "2"),
        one(3, "status", "MAPPING", None, F.when(k % 11 != 0, "Status"), None, F.when(k % 3 == 0, 0).otherwise(4)),
        one(4, "currency", "CONSTANT", None, None, F.when(k % 4 != 0, "VND").otherwise("")),
    )
    return table(spark, d, "customer").select(F.col("c_custkey").alias("config"), F.explode(maps).alias("m")).select("config", "m.*")


_FINDINGS = """WITH f AS (SELECT c_custkey AS config, unnest(list_filter([
  CASE WHEN c_custkey % 5 = 0 THEN {'code': 'DUPLICATE_PATH', 'path': 'id'} END, CASE WHEN c_custkey % 7 = 0 THEN {'code': 'INVALID_COLUMN', 'path': 'id'} END,
  CASE WHEN c_custkey % 3 = 0 THEN {'code': 'EMPTY_MAPPING', 'path': 'status'} END, CASE WHEN c_custkey % 11 = 0 THEN {'code': 'NO_SOURCE', 'path': 'status'} END,
  CASE WHEN c_custkey % 4 = 0 THEN {'code': 'EMPTY_CONSTANT', 'path': 'currency'} END], lambda x: x IS NOT NULL)) AS x FROM customer)"""


@query(_FINDINGS + " SELECT config, x.code AS code, x.path AS path FROM f")
def mapping_config_rules(spark, d):
    return mapping.config_findings(configurations(spark, d))


@query(_FINDINGS + ", n AS (SELECT config, count(*) AS findings FROM f GROUP BY 1) SELECT c_custkey AS config, coalesce(findings, 0) AS findings, CAST(greatest(0, 100 - 15 * coalesce(findings, 0)) AS INTEGER) AS score FROM customer LEFT JOIN n ON c_custkey = config")
def mapping_config_scores(spark, d):
    return mapping.config_scores(configurations(spark, d))


@query("""WITH o AS (SELECT o_orderkey AS file, o_custkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 2 END AS n, o_orderkey % 4 = 2 AS renamed FROM orders),
f AS (SELECT file, unnest(list_filter([
  CASE WHEN k % 5 = 0 THEN 'BATCH_FATAL:REQUIRED_SCHEMA_PATH' END,
  CASE WHEN k % 7 = 0 OR k % 3 + 1 > n THEN 'BATCH_FATAL:MISSING_REQUIRED_SOURCE_COLUMN' END,
  CASE WHEN k % 11 = 0 OR n < 3 THEN 'BATCH_FATAL:MISSING_REQUIRED_SOURCE_COLUMN' END,
  CASE WHEN n = 4 THEN 'WARNING:SCHEMA_CONFIG_DRIFT' WHEN renamed OR n < 3 THEN 'BATCH_FATAL:SCHEMA_CONFIG_DRIFT' END], lambda x: x IS NOT NULL)) AS x FROM o)
SELECT file, split_part(x, ':', 1) AS outcome, split_part(x, ':', 2) AS code, count(*) AS n FROM f GROUP BY ALL""")
def file_gates(spark, d):
    """Files of all orders against the configurations of their customers: unchanged, with a new column, renamed or cut."""
    known = F.array(*map(F.lit, ("Id", "Amount", "Status")))
    k = F.col("o_orderkey")
    headers = F.when(k % 4 == 0, known).when(k % 4 == 1, F.array_append(known, F.lit("New"))).when(k % 4 == 2, F.array(F.lit("Key"), F.lit("Amount"), F.lit("Status"))).otherwise(F.slice(known, 1, 2))
    files_ = table(spark, d, "orders").select(k.alias("file"), F.col("o_custkey").alias("config"), headers.alias("headers"))
    expected = table(spark, d, "customer").select(F.col("c_custkey").alias("config"), known.alias("known"))
    return mapping.gate_findings(files_, configurations(spark, d), expected).groupBy("file", "outcome", "code").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN event_id < 26 THEN chr(CAST(65 + event_id AS INTEGER)) WHEN event_id < 702 THEN chr(CAST(64 + event_id // 26 AS INTEGER)) || chr(CAST(65 + event_id % 26 AS INTEGER))
  ELSE chr(CAST(65 + (event_id - 702) // 676 AS INTEGER)) || chr(CAST(65 + (event_id - 702) // 26 % 26 AS INTEGER)) || chr(CAST(65 + (event_id - 702) % 26 AS INTEGER)) END AS letters, event_id + 1 AS number FROM events WHERE event_id < 18278""")
def column_letters(spark, d):
    """Numbers of columns to spreadsheet letters, up to the last of three letters, and back."""
    rows = table(spark, d, "events").where("event_id < 18278").select("event_id", mapping.letters_of(F.col("event_id") + 1).alias("letters"))
    return rows.withColumn("number", mapping.number_of(F.col("letters")))


@query("""SELECT event_type, CASE WHEN event_id % 2 = 0 THEN 'failed: token=*** for db://u:***@h' ELSE 'failed: ' || event_type END AS message, count(*) AS n FROM events GROUP BY ALL""")
def scrubbed_messages(spark, d):
    k = F.col("event_id")
    secret = F.concat(F.lit("failed: token="), k.cast("string"), F.lit(" for db://u:p"), k.cast("string"), F.lit("@h"))
    message = F.when(k % 2 == 0, secret).otherwise(F.concat(F.lit("failed: "), F.col("event_type")))
    return table(spark, d, "events").groupBy("event_type", text.scrubbed(message).alias("message")).agg(F.count("*").alias("n"))


# Keys and names


@query(f"""WITH {RELATIONS} SELECT partner, date, key, count(*) AS n, array_to_string(list_sort(list(id)), ',') AS record_ids,
min(CASE WHEN id LIKE '%b' THEN 'BUSINESS_LOCAL' ELSE 'CANONICAL_UTC' END) AS basis FROM p WHERE key IS NOT NULL GROUP BY ALL""")
def partner_key_groups(spark, d):
    """Rows, ids and the least timestamp basis of every partner key; second copies have another basis."""
    basis = F.when(F.col("id").endswith("b"), "BUSINESS_LOCAL").otherwise("CANONICAL_UTC")
    groups = match.partner_groups(workload.partner_transaction(spark, d).withColumn("timestamp_basis", basis))
    return groups.withColumn("record_ids", F.array_join("record_ids", ","))


@query("""SELECT strftime(CAST(o_orderdate AS DATE), 'P_%Y%m%d_') || '*_' || strftime(CAST(o_orderdate AS DATE), '%d-%m-%y') || '.csv' AS name, count(*) AS n FROM orders GROUP BY 1""")
def drop_names(spark, d):
    """Patterns of the files that are due on each day of orders."""
    name = files.dated_names("P_{date:%Y%m%d}_*_{date:%d-%m-%y}.csv", F.to_date("o_orderdate"))
    return table(spark, d, "orders").groupBy(name.alias("name")).agg(F.count("*").alias("n"))


# Scope and state

_COUNTED = f"""WITH {RELATIONS}, a AS (SELECT partner, date, count(*) AS received, count(DISTINCT file) AS files FROM p GROUP BY ALL), b AS (SELECT partner, date, count(*) AS internals FROM i_all GROUP BY ALL),
c AS (SELECT coalesce(a.partner, b.partner) AS partner, coalesce(a.date, b.date) AS date, coalesce(received, 0) AS received, coalesce(files, 0) AS files, coalesce(internals, 0) AS internals FROM a FULL OUTER JOIN b ON a.partner = b.partner AND a.date = b.date)"""


def _counted(spark: SparkSession, d: str) -> DataFrame:
    a = match.partner_side(workload.partner_transaction(spark, d)).groupBy("partner", "date").agg(F.count("*").alias("received"), F.count_distinct("file").alias("files"))
    b = match.internal_side(workload.internal_transaction(spark, d)).groupBy("partner", "date").agg(F.count("*").alias("internals"))
    return a.join(b, ["partner", "date"], "full_outer").fillna(0, ["received", "files", "internals"])


@query(_COUNTED + """ SELECT CASE WHEN files = 0 THEN 'FULL_SNAPSHOT' WHEN internals = 0 THEN 'UNCONFIRMED' ELSE 'REPLACEMENT' END AS scope,
CAST(CASE WHEN files = 0 THEN 0.82 WHEN internals = 0 THEN 0.45 ELSE 0.6 END AS DECIMAL(4,2)) AS confidence, count(*) AS days FROM c GROUP BY ALL""")
def scope_file_default(spark, d):
    name, sure = scope.file_scope(F.col("files"), F.col("internals"), "REPLACEMENT")
    return _counted(spark, d).groupBy(name.alias("scope"), sure.alias("confidence")).agg(F.count("*").alias("days"))


@query(_COUNTED + """, g AS (SELECT *, greatest(internals, received) AS larger, abs(internals - received) AS gap FROM c),
s AS (SELECT *, CASE WHEN received <= 0 THEN 1 WHEN internals <= 0 THEN 2 WHEN gap <= greatest(10, floor(larger * 0.05)) OR gap <= larger * 0.05 THEN 3 WHEN received < internals * 0.8 THEN 4 ELSE 5 END AS k FROM g)
SELECT CAST([0.34, 0.9, 0.82, 0.18, 0.62][k] AS DECIMAL(4,2)) AS full_snapshot, CAST([0.33, 0.07, 0.14, 0.72, 0.28][k] AS DECIMAL(4,2)) AS append, CAST([0.33, 0.03, 0.04, 0.1, 0.1][k] AS DECIMAL(4,2)) AS replacement, count(*) AS days FROM s GROUP BY ALL""")
def scope_probabilities(spark, d):
    p = scope.count_probabilities(F.col("internals"), F.col("received"))
    each = [p[name].alias(column) for name, column in (("FULL_SNAPSHOT", "full_snapshot"), ("INCREMENTAL_APPEND", "append"), ("REPLACEMENT", "replacement"))]
    return _counted(spark, d).select(*each).groupBy("full_snapshot", "append", "replacement").agg(F.count("*").alias("days"))


@query("""WITH s AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'FULL_SNAPSHOT' ELSE 'INCREMENTAL_APPEND' END AS scope, event_id * 40 AS a, event_id * 40 - event_id % 5000 AS b FROM events),
g AS (SELECT *, greatest(a, b, 1) AS larger, abs(a - b) AS gap FROM s)
SELECT scope, scope = 'INCREMENTAL_APPEND' AND (larger >= 10000 AND gap <= larger * 0.05 OR larger >= 100000 AND gap <= greatest(10, floor(larger * 0.01))) AS overridden, count(*) AS n FROM g GROUP BY ALL""")
def scope_overridden(spark, d):
    k = F.col("event_id")
    name = F.when(k % 3 == 0, "FULL_SNAPSHOT").otherwise("INCREMENTAL_APPEND")
    rows = table(spark, d, "events").select(name.alias("scope"), scope.overridden(name, k * 40, k * 40 - k % 5000).alias("overridden"))
    return rows.groupBy("scope", "overridden").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, bool_or(event_type = 'click') AS approved, count(*) FILTER (WHERE event_type = 'view' AND event_id % 50 = 0) AS pending FROM events WHERE user_id IS NOT NULL GROUP BY 1)
SELECT CASE WHEN pending > 0 THEN CASE WHEN approved THEN 'NEEDS_REVIEW' ELSE 'BLOCKED' END WHEN approved THEN 'ACTIVE' ELSE 'NO_ACTIVITY' END AS state, count(*) AS partners FROM s GROUP BY 1""")
def partner_states(spark, d):
    held = F.count_if((F.col("event_type") == "view") & (F.col("event_id") % 50 == 0))
    each = table(spark, d, "events").where("user_id IS NOT NULL").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "click").alias("approved"), held.alias("pending"))
    return each.groupBy(recovery.partner_state(F.col("approved"), F.col("pending")).alias("state")).agg(F.count("*").alias("partners"))
