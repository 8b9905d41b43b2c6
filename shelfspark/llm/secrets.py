"""Secret scan with corpus-wide ownership (DataFrame functions only).

Patterns give candidates with their places.  Hashes of the candidate values
are then counted over the whole corpus by distinct repositories and owners:
a value that more than `max_owners` owners carry is a widely copied example,
one that few own looks live.  Beside the base kinds the scan looks at bare
tokens - long runs of key characters with a letter and a digit - which only
count as secrets where their ownership says so; they are the added spans.

Owner and repository are column names; here a document's `source` owns it and
each document is a repository.  Counting goes (value, owner, repository) ->
(value, owner) -> (value), each step combined per task before it is shuffled,
so a value copied into a third of all documents is no hot task.

Defined results: a null text counts as empty and has no span; a null owner is
an owner of its own; rows that repeat an id are scanned one by one and count as
one repository; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import materialise, text_or_empty

#: The kinds in their listed order with pattern, value group and least value length.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]{24,})", 1, 24),
    "bare": (r"([A-Za-z0-9+/_=-]{20,})", 1, 20),
}
BASE = ("assign", "access", "hex")
MAX_OWNERS = 2
#: Matches of a text whose places are added up together.
BLOCK = 256

_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def find_spans(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches as (start, rank, kind, end, value).

    Places come from the lengths of the pieces between the matches."""
    pattern, group, least = KINDS[kind]
    regex = F.lit(pattern)
    rank = list(KINDS).index(kind)
    pieces = F.split(text, pattern)
    found = F.arrays_zip(F.regexp_extract_all(text, regex.alias("m"), F.lit(0)).alias("whole"), F.regexp_extract_all(text, regex, F.lit(group)).alias("value"), pieces.alias("before"))
    # the last piece follows the last match
    matches = F.transform(F.slice(found, 1, F.size(pieces) - 1), lambda x: F.struct(
        F.length(x["before"]).alias("gap"), F.length(x["whole"]).alias("length"), x["value"].alias("value")))

    def places(block: Column, at: Column) -> Column:
        """Spans of one block of matches, the first gap starting at `at`."""
        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["gap"]
            end = begin + x["length"]
            one = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
            keep = F.length(x["value"]) >= least
            return F.struct(end.alias("at"), F.when(keep, F.array_append(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("spans")), step)["spans"]

    def of_text(all_: Column) -> Column:
        # appending copies an array, so spans are gathered by blocks, and blocks joined at once
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda k: F.slice(all_, k * BLOCK + 1, BLOCK))
        sizes = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + x["length"]))
        starts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
        return F.flatten(F.zip_with(blocks, starts, lambda block, at: F.when(block.isNotNull(), places(block, at)).otherwise(F.array().cast(_SPAN))))

    # bound once: each block reads it
    spans = F.element_at(F.transform(F.array(matches), of_text), 1)
    return F.when(F.size(pieces) > 1, spans).otherwise(F.array().cast(_SPAN))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then listed kind."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example),
    one row per document; n_live and n_example count its spans by ownership."""
    texts = docs.select("doc_id", F.col(owner).alias("__owner"), F.col(repository).alias("__repo"), text_or_empty().alias("t"))
    by_kind = texts.select("doc_id", "__owner", "__repo", *[find_spans(F.col("t"), k).alias(k) for k in KINDS])
    base = by_kind.withColumn("base", F.concat(*BASE))
    # a bare token has a letter and a digit and shares no character with a base span
    bare = F.filter("bare", lambda b: b["value"].rlike("[0-9]") & b["value"].rlike("[A-Za-z]")
                    & ~F.exists("base", lambda s: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    scanned = base.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "__owner", "__repo",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        F.transform(F.concat("base", bare), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), F.unhex(F.md5(s["value"])).alias("h"))).alias("found"))
    scanned = materialise(scanned, "secret-spans")

    each = scanned.select("row", "__owner", "__repo", F.explode("found").alias("s")).select("row", "__owner", "__repo", "s", F.col("s.h").alias("h"))
    owned = (each.select("h", "__owner", "__repo").distinct()
             .groupBy("h", "__owner").agg(F.count("*").alias("repos"))
             .groupBy("h").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos")))
    live = F.col("n_owners") <= max_owners
    kept = each.join(owned, "h").filter(live | (F.col("s.kind") != "bare"))
    per_row = kept.groupBy("row").agg(
        F.collect_list(F.struct("s.start", "s.rank", "s.kind", "s.end")).alias("all"),
        F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_example"))
    zero = F.lit(0).cast("long")
    return scanned.drop("found").join(per_row, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(joined(F.col("all")), F.lit("")).alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example"))
