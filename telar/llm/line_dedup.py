"""Repeated multi-line chunks, cut at boundaries that the lines' own content chooses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.llm._common import forget, fresh, materialize, named, sent

#: A line's hash counts this much in the next line's rolling hash.
ROLL = 31


def _chunked(lined: DataFrame, divisor: int) -> DataFrame:
    """lined (.., lines) with chunks: (first, last) line numbers of the chunks of two lines or more.

    The rolling hash at a line covers it and the line before; a chunk ends where it is divisible by `divisor`, so
    boundaries move with the content and come again two lines after any insertion. Each step is a column of its own, so
    that no line is hashed twice.
    """
    keep = lined.columns
    hashed = lined.select(*keep, F.transform("lines", lambda x: F.conv(F.substring(F.md5(x), 1, 11), 16, 10).cast("long")).alias("hs"))
    # slice by slice: the hashes of the lines before, with 0 before the first
    rolled = F.zip_with("hs", F.concat(F.array(F.lit(0).cast("long")), F.slice("hs", 1, F.size("hs") - 1)), lambda a, b: (a + b * ROLL) % divisor)
    flagged = hashed.select(*keep, F.size("hs").alias("n"), rolled.alias("rs")).select(*keep, F.transform("rs", lambda r, i: F.when((r == 0) | (i == F.col("n") - 1), i)).alias("flags"))
    ended = flagged.select(*keep, F.filter("flags", lambda i: i.isNotNull()).alias("ends"))
    befores = F.concat(F.array(F.lit(-1)), F.slice("ends", 1, F.size("ends") - 1))
    bounds = ended.select(*keep, F.zip_with(befores, "ends", lambda a, b: F.struct((a + 1).alias("first"), b.alias("last"))).alias("all"))
    return bounds.select(*keep, F.filter("all", lambda c: c["last"] > c["first"]).alias("chunks"))


def _text(c: F.Column) -> F.Column:
    return F.array_join(F.slice("lines", c["first"] + 1, c["last"] - c["first"] + 1), "\n")


def dedup_chunks(docs: DataFrame, divisor: int = 4, counter: str = "n_removed_lines") -> DataFrame:
    """docs, with multi-line chunks that stand earlier in the table removed from text, and n_removed_lines added.

    Lines are cut into chunks of `divisor` lines on average by _chunked. Chunks of two lines or more are grouped
    by hash over the whole table; those of repeated hashes are compared byte by byte, by grouping on their text. Of
    equal chunks the one with the smallest (doc_id, line) stays, the rest go. Single lines stay, however often they
    repeat.

    Hashes are written once, and hashes and texts are grouped with partial aggregation, so that a chunk of any number of
    copies is no hot spot; only texts of repeated hashes are shuffled by chunk. Documents meet the lists of their repeated
    chunks, and later of those that go, where they are as long as these lists are small enough to be sent to all; beyond
    that they are exchanged, twice. Work grows with a text's lines.

    A null text stays null, an empty text empty, both with 0 removed; a text all of whose lines go becomes empty. Texts of
    any length are read whole. A null doc_id ranks first. Rows with equal doc_id and text are treated alike. Other columns
    stay as they are, whatever their names; one named like `counter` is replaced. An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() != counter.lower()]
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.col("text").alias("text"), F.struct(*[named(c).alias(c) for c in kept if c.lower() not in ("doc_id", "text")], F.lit(0).alias(fresh(docs, "none"))).alias("row"))
    # a text of one line has no chunk
    lined = rows.filter(F.instr("text", "\n") > 0).select("id", "h", F.split("text", "\n", -1).alias("lines"))
    chunks = _chunked(lined, divisor).select("id", "h", F.explode(F.transform("chunks", lambda c: F.struct(c.alias("c"), F.xxhash64(_text(c)).alias("ch")))).alias("x")).select("id", "h", "x.c", "x.ch")
    chunks = materialize(chunks)
    repeated = chunks.groupBy("ch").agg(F.count("*").alias("k")).filter("k > 1").select("ch")
    found = materialize(chunks.join(repeated, "ch").groupBy(F.col("id").alias("fid"), F.col("h").alias("fh")).agg(F.collect_list("c").alias("cs")))
    forget(chunks)
    same = F.col("id").eqNullSafe(F.col("fid")) & F.col("h").eqNullSafe(F.col("fh"))
    texts = lined.join(sent(found, F.size("cs") * 32 + 64), same).select("id", "h", F.explode(F.transform("cs", lambda c: F.struct(c.alias("c"), _text(c).alias("t")))).alias("x")).select("id", "h", "x.c", "x.t")
    place = F.struct("id", "h", "c")
    firsts = texts.groupBy("t").agg(F.min(place).alias("first"), F.count("*").alias("k")).filter("k > 1").drop("k")
    gone = texts.join(firsts, "t").filter(~place.eqNullSafe(F.col("first")))
    gone = materialize(gone.groupBy(F.col("id").alias("fid"), F.col("h").alias("fh")).agg(F.array_sort(F.collect_set("c")).alias("gone")))
    forget(found)
    # the lines between the chunks that go, slice by slice
    split = rows.join(sent(gone, F.size("gone") * 32 + 64), same, "left").withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("text", "\n", -1)))
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda c: c["last"] + 1))
    stops = F.concat(F.transform("gone", lambda c: c["first"]), F.array(F.size("lines")))
    cut = split.withColumn("spans", F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("a"), (b - a).alias("n"))))
    text = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice("lines", s["a"] + 1, s["n"]))), "\n")
    lost = F.aggregate("gone", F.lit(0).cast("long"), lambda a, c: a + c["last"] - c["first"] + 1)
    out = {"text": F.coalesce(text, F.col("text")), "doc_id": F.col("id")}
    return cut.select(*[(out[c.lower()] if c.lower() in out else F.col("row").getField(c)).alias(c) for c in kept], F.coalesce(lost, F.lit(0)).cast("long").alias(counter))


CHUNKS_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS pos, len(lines) AS n FROM l),
h AS (SELECT *, CAST(('0x' || substr(md5(line), 1, 11)) AS BIGINT) AS h FROM x),
r AS (SELECT *, (h + 31 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY pos), 0)) % 4 = 0 OR pos = n - 1 AS ends FROM h),
c AS (SELECT *, coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM r),
t AS (SELECT doc_id, c, count(*) AS k, min(pos) AS first, string_agg(line, chr(10) ORDER BY pos) AS t FROM c GROUP BY doc_id, c),
k AS (SELECT *, CASE WHEN k > 1 THEN row_number() OVER (PARTITION BY t, k > 1 ORDER BY doc_id, first) ELSE 1 END AS rank FROM t),
d AS (SELECT doc_id, coalesce(string_agg(t, chr(10) ORDER BY first) FILTER (WHERE rank = 1), '') AS text, CAST(coalesce(sum(k) FILTER (WHERE rank > 1), 0) AS BIGINT) AS n_removed_lines FROM k GROUP BY doc_id)
SELECT doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE d.text END AS text, lang, source, n_chars, coalesce(n_removed_lines, 0) AS n_removed_lines FROM documents LEFT JOIN d USING (doc_id)
"""
