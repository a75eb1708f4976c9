"""Removal of chunks of lines that repeat anywhere in the corpus, with content-defined boundaries.

A rolling hash over the hashes of adjacent lines passes over every text, in
windows of two lines; so do a line with the next visible one and the blank lines
between, and a line of ``MIN_WORDS`` words alone. The hashes are counted over
the corpus. A chunk begins where the rolling hash becomes one that occurs
elsewhere and ends where it ceases to, so its boundaries depend on its own lines
alone and move with them: a run of two lines is found whatever stands around it.
Each window points to the place of its first occurrence, the smallest (doc_id,
position); lines there are sent to the later copies, and a line goes only if it
equals the line it points to byte for byte. Windows without a visible character
do not count. Only DataFrame functions are used.

Frequent windows and lines are salted: those that hold a ``PARTS``-th of all
rows or more are at most ``PARTS``, so their list is broadcast, and their rows
are dealt over as many salts as their share asks for. All other joins shuffle at
every size, as no bound of theirs is known.

Defined results: a null text stays null and counts no lines; an empty text has
one empty line; null doc_ids come last in the order of occurrences; rows of
equal id and text are one document and are cut alike; other columns are kept.
Blank lines at the edge of a chunk, beyond one, stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import dropped, stored, table

#: A single line is a chunk of its own if it has so many words.
MIN_WORDS = 50
#: Keys that hold this part of all rows are salted.
PARTS = 1024
_WORD = r"[^\x20\x09-\x0D]+"
_NONE = "array<struct<start:int,n:int>>"


def _ident() -> Column:
    text = F.md5(F.coalesce(F.col("text"), F.lit("")))
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text)))


def _lines() -> Column:
    return F.split("text", "\n", -1)


def _upto(last: Column) -> Column:
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _windows(lines: Column) -> Column:
    """start, n of all windows that count: adjacent lines, visible lines with the blank ones between, and long lines."""

    def seen(i: Column) -> Column:
        return F.get(F.col("seen"), i)

    def long(i: Column) -> Column:
        line = F.get(lines, i)
        return (F.length(line) >= 2 * MIN_WORDS - 1) & (F.regexp_count(line, F.lit(_WORD)) >= MIN_WORDS)

    def spans(starts: Column, n: int) -> Column:
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(n).alias("n")))

    every = _upto(F.size(lines) - 1)
    visible = F.filter(every, seen)
    after = F.slice(visible, 2, F.size(visible))
    gaps = F.zip_with(visible, after, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("n")))
    gaps = F.filter(gaps, lambda s: s["n"] > 3)  # nulls, as after the last visible line, do not pass
    pairs = F.filter(_upto(F.size(lines) - 2), lambda i: seen(i) | seen(i + 1))
    return F.concat(spans(pairs, 2), spans(F.filter(every, long), 1), gaps)


def windows(docs: DataFrame) -> DataFrame:
    """ident, doc_id, start, n, and a hash of 128 bits (h, g) over the line hashes, of every window that counts."""
    lines = docs.where(F.col("text").isNotNull()).select(_ident().alias("ident"), "doc_id", _lines().alias("lines"))
    lines = lines.select(
        "ident",
        "doc_id",
        "lines",
        F.transform("lines", lambda x: x.rlike(_WORD)).alias("seen"),
        F.transform("lines", lambda x: F.xxhash64(x)).alias("h"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(1), x)).alias("g"),
    )

    def rolled(hashes: str, s: Column) -> Column:
        return F.xxhash64(F.slice(hashes, s["start"] + 1, s["n"]))

    found = F.transform(_windows(F.col("lines")), lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"), rolled("h", s).alias("h"), rolled("g", s).alias("g")))
    return lines.select("ident", "doc_id", F.inline(found))


def _salted(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` and ``keys`` (which has ``count``, the rows of each key) with a salt that deals the rows of frequent keys."""
    hot = keys.where(F.col("count") * PARTS >= F.lit(total)).select(*on, F.ceil(F.col("count") * PARTS / F.lit(max(1, total))).cast("int").alias("salts"))
    dealt = rows.join(F.broadcast(hot), on, "left")  # at most PARTS keys
    dealt = dealt.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("ident", "at"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    many = F.when(F.col("count") * PARTS >= F.lit(total), F.ceil(F.col("count") * PARTS / F.lit(max(1, total)))).otherwise(1).cast("int")
    return dealt, keys.withColumn("salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("count")


def repeats(docs: DataFrame) -> DataFrame:
    """ident, cuts: of each document the lines that repeat earlier ones, as (at, line), ``line`` being the earlier one's bytes."""
    found = stored(windows(docs).withColumnRenamed("start", "at"), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc"), "ident", "at")
    first = found.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("hi"), F.count("*").alias("count")).where("first <> hi").drop("hi")
    first = stored(first, "first")
    dealt, keys = _salted(found, first, ["h", "g"], found.count())
    later = dealt.join(keys.hint("merge"), ["h", "g", "salt"]).where((F.col("ident") != F.col("first.ident")) | (F.col("at") != F.col("first.at")))
    line = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")
    later = later.select("ident", "at", F.col("first.ident").alias("source"), F.col("first.at").alias("from"), line)
    later = later.select("ident", (F.col("at") + F.col("k")).alias("at"), "source", (F.col("from") + F.col("k")).alias("from"))
    later = later.groupBy("ident", "at").agg(F.min(F.struct("source", "from")).alias("s")).select("ident", "at", "s.source", "s.from")
    later = stored(later, "later")
    dropped(found)
    dropped(first)

    wanted = stored(later.groupBy("source", "from").count(), "wanted")
    dealt, keys = _salted(later, wanted, ["source", "from"], later.count())
    asked = keys.groupBy(F.col("source").alias("ident")).agg(F.collect_list(F.struct("from", "salt")).alias("asked"))  # within one document
    texts = docs.where(F.col("text").isNotNull()).select(_ident().alias("ident"), "text").join(asked.hint("merge"), "ident")
    texts = texts.select("ident", "asked", _lines().alias("lines"))
    sent = texts.select(F.col("ident").alias("source"), F.inline(F.transform("asked", lambda a: F.struct(a["from"].alias("from"), a["salt"].alias("salt"), F.get("lines", a["from"]).alias("line")))))
    sent = sent.groupBy("source", "from", "salt").agg(F.first("line").alias("line"))  # repeated rows of a document send a line twice
    both = dealt.join(sent.hint("merge"), ["source", "from", "salt"])
    return both.groupBy("ident").agg(F.collect_list(F.struct("at", "line")).alias("cuts"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with later copies of chunks cut from ``text``, and with n_lines and n_removed."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    nested = docs.select(F.struct(*own).alias("doc"), _ident().alias("ident"))  # no other column can clash
    wide = nested.join(repeats(docs).hint("merge"), "ident", "left").withColumn("lines", F.split("doc.text", "\n", -1))
    equal = F.filter("cuts", lambda c: c["line"] == F.get("lines", c["at"]))
    gone = F.map_from_entries(F.transform(equal, lambda c: F.struct(c["at"], F.lit(True))))
    wide = wide.withColumn("gone", gone)
    kept = F.array_join(F.filter("lines", lambda _, i: ~F.coalesce(F.try_element_at("gone", i), F.lit(False))), "\n")
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(kept)
    n_lines = F.when(F.col("doc.text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    return wide.select(
        *[text.alias(c) if c == "text" else F.col(f"doc.{c}").alias(c) for c in own],
        n_lines.alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the cleaned text's MD5 for every document."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


#: The name under which the rule of all windows was first registered, beside an earlier one that missed short passages.
op9_line_runs = op9_line_dedup


def _oracle() -> str:
    return f"""
WITH docs AS (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS ident FROM documents),
held AS (SELECT DISTINCT ident, doc_id, text FROM docs WHERE text IS NOT NULL),
lines AS (
  SELECT ident, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM held),
seen AS (SELECT *, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS visible FROM lines),
spans AS (
  SELECT ident, doc_id, pos AS start, 2 AS n
  FROM (SELECT *, lead(visible) OVER (PARTITION BY ident ORDER BY pos) AS ahead FROM seen) WHERE ahead IS NOT NULL AND (visible OR ahead)
  UNION ALL
  SELECT ident, doc_id, pos, 1 FROM lines WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= {MIN_WORDS}
  UNION ALL
  SELECT ident, doc_id, pos, ahead - pos + 1
  FROM (SELECT *, lead(pos) OVER (PARTITION BY ident ORDER BY pos) AS ahead FROM seen WHERE visible) WHERE ahead - pos > 2),
counted AS (
  SELECT s.ident, s.doc_id, s.start, s.n, string_agg(l.line, chr(10) ORDER BY l.pos) AS bytes
  FROM spans s JOIN lines l ON l.ident = s.ident AND l.pos BETWEEN s.start AND s.start + s.n - 1 GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bytes ORDER BY doc_id IS NULL, doc_id, ident, start) AS place FROM counted),
gone AS (SELECT DISTINCT r.ident, l.pos FROM ranked r JOIN lines l ON l.ident = r.ident AND l.pos BETWEEN r.start AND r.start + r.n - 1 WHERE r.place > 1),
kept AS (
  SELECT l.ident, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS cleaned
  FROM lines l LEFT JOIN gone g ON g.ident = l.ident AND g.pos = l.pos GROUP BY l.ident)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN md5(k.cleaned) END AS text_md5
FROM docs d LEFT JOIN kept k ON k.ident = d.ident"""


ORACLE = {"op9_line_dedup": _oracle(), "op9_line_runs": _oracle()}
