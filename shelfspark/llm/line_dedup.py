"""Line deduplication by overlapping three-line windows (DataFrame functions only).

Every run of three consecutive lines is hashed (128 bits over the trimmed
lines).  A window seen anywhere before - smaller document id, then smaller
line - is a repeat; the positions of all repeats of a document are merged and
the lines they cover are removed.  First occurrences stay whole.

Only (hash, id, line number) rows are shuffled by hash, first combined per
task, and the first occurrence is handed back by a join that Spark can split,
so a window that a third of all documents share is no hot task.

Defined results: a null text counts as empty; documents under three lines have
no window and stay as they are; windows of three blank lines are ignored; null
ids come last; rows that repeat id and text are one document and come out
alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import materialise, text_or_empty

WINDOW = 3
#: Characters trimmed from both ends of a line before it is compared.
BLANKS = " \t\r\x0b\x0c"


def _windows(lines: Column) -> Column:
    trimmed = F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS)))
    last = F.size(lines) - WINDOW
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    # a window is the slice of trimmed lines joined by line feeds; blank ones are dropped
    joined = F.transform(starts, lambda p: F.struct(p.alias("pos"), F.array_join(F.slice(trimmed, p + 1, WINDOW), "\n").alias("w")))
    return F.transform(F.filter(joined, lambda x: x["w"] != "\n" * (WINDOW - 1)),
                       lambda x: F.struct(x["pos"].alias("pos"), F.unhex(F.md5(x["w"])).alias("h")))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_key, covered): per document, the sorted line numbers under repeats."""
    lines = docs.select("doc_id", F.xxhash64("doc_id", text_or_empty()).alias("doc_key"), F.split(text_or_empty(), "\n").alias("lines"))
    rows = materialise(
        lines.select("doc_id", "doc_key", F.explode(_windows(F.col("lines"))).alias("w"))
        .select(F.col("w.h").alias("h"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc_key", F.col("w.pos").alias("pos")).alias("at")),
        "line-windows")
    first = rows.groupBy("h").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = rows.join(first, "h").filter(F.col("at") != F.col("first"))
    return (again.select(F.col("at.doc_key").alias("doc_key"), F.explode(F.sequence(F.col("at.pos"), F.col("at.pos") + (WINDOW - 1))).alias("line"))
            .groupBy("doc_key").agg(F.array_sort(F.collect_set("line")).alias("covered")))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, removed) for every document; `removed`
    lists the removed line numbers, comma-joined."""
    covered = repeated_lines(docs)
    lines = docs.select("doc_id", F.xxhash64("doc_id", text_or_empty()).alias("doc_key"), F.split(text_or_empty(), "\n").alias("lines"))
    none = F.array().cast("array<int>")
    joined = lines.join(covered, "doc_key", "left").withColumn("covered", F.coalesce("covered", none))
    # removed numbers as a map would be quadratic; kept numbers come from one set difference
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    return joined.withColumn("kept", kept).select(
        "doc_id",
        F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"), F.size("covered").cast("long").alias("n_removed"),
        F.array_join(F.col("covered").cast("array<string>"), ",").alias("removed"))


ORACLE_SQL = """
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
t as (select doc_id, lines,
        [trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) for x in lines] as trimmed from d),
p as (select doc_id, trimmed, unnest(range(0, len(lines) - 2)) as pos from t where len(lines) >= 3),
w as (select doc_id, pos, trimmed[pos + 1] || chr(10) || trimmed[pos + 2] || chr(10) || trimmed[pos + 3] as w from p),
r as (select doc_id, pos, row_number() over (partition by w order by doc_id, pos) as nth from w where w <> chr(10) || chr(10)),
c as (select distinct doc_id, unnest([pos, pos + 1, pos + 2]) as line from r where nth > 1),
l as (select d.doc_id, i as line, d.lines[i + 1] as x, len(d.lines) as n_lines
      from d, unnest(range(0, len(d.lines))) as u(i)),
k as (select l.*, c.line is not null as gone from l left join c on l.doc_id = c.doc_id and l.line = c.line)
select doc_id, coalesce(string_agg(x, chr(10) order by line) filter (not gone), '') as text, max(n_lines) as n_lines,
       count(*) filter (gone) as n_removed, coalesce(string_agg(line::varchar, ',' order by line) filter (gone), '') as removed
from k group by doc_id
"""
