"""Repeated lines or paragraphs, removed everywhere but at their earliest occurrence."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.llm._common import forget, materialize, sent


def _normal(unit: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(unit), r"[ \t\r\n\f]+", " "))


def dedup_units(docs: DataFrame, separator: str = "\n", min_words: int = 5) -> DataFrame:
    """(doc_id, text, n_removed, kept_offsets) of every row, its repeated units removed.

    A unit is what stands between separators: a line, or with a separator of two line feeds a paragraph. Units are
    equal if they are after lower-casing, with runs of ASCII white space as one space. Of equal units all over the
    table the one with the smallest (doc_id, place) stays, the rest go. kept_offsets lists where in the original text,
    in characters, the units that stay began, joined by commas. Units of fewer than min_words words always stay, as
    such lines repeat by chance.

    Digests of 128 bits are counted with partial aggregation, so that a line of any number of copies is no hot spot;
    the occurrences of repeated digests are then found by a join, which adaptive execution divides where it is skewed.
    Documents meet the lists of their units that go where they are as long as these are small enough to be sent to all;
    beyond that they are exchanged.

    A null text stays null, with 0 removed and kept_offsets null; an empty text is one empty unit, which stays. A text
    all of whose units go becomes empty. Texts of any length are read whole. A null doc_id ranks first. Rows with equal
    doc_id and text are treated alike.
    An empty table gives an empty result. Other columns are left out, whatever their names.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    units = rows.select("doc_id", "_h", F.posexplode(F.split("text", f"\\Q{separator}\\E", -1)).alias("_pos", "_unit"))
    units = units.select("doc_id", "_h", "_pos", _normal(F.col("_unit")).alias("_u")).filter(F.size(F.split("_u", " ")) >= min_words)
    units = units.select("doc_id", "_h", "_pos", F.unhex(F.md5("_u")).alias("_d"))
    place = F.struct("doc_id", "_h", "_pos")
    units = materialize(units)  # digested once
    repeated = units.groupBy("_d").agg(F.min(place).alias("_first"), F.count("*").alias("_k")).filter("_k > 1").select("_d", "_first")
    gone = units.join(repeated, "_d").filter(~place.eqNullSafe(F.col("_first")))
    gone = materialize(gone.groupBy(F.col("doc_id").alias("_id"), F.col("_h").alias("_gh")).agg(F.collect_set("_pos").alias("_gone")))
    forget(units)
    joined = rows.join(sent(gone, F.size("_gone") * 4 + 64), F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_h").eqNullSafe(F.col("_gh")), "left").select("doc_id", "text", "_gone")
    width = len(separator)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                out, removed, offsets = [], [], []
                for text, gone_ in zip(b.column("text").to_pylist(), b.column("_gone").to_pylist()):
                    if text is None:
                        out.append(None), removed.append(0), offsets.append(None)
                        continue
                    lost = set(gone_ or ())
                    kept, starts, start = [], [], 0
                    for i, unit in enumerate(text.split(separator)):
                        if i not in lost:
                            kept.append(unit)
                            starts.append(start)
                        start += len(unit) + width
                    out.append(separator.join(kept) if lost else text)
                    removed.append(len(lost))
                    offsets.append(",".join(map(str, starts)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string()), pa.array(removed, pa.int64()), pa.array(offsets, pa.string())], names=["doc_id", "text", "n_removed", "kept_offsets"])

    return joined.mapInArrow(rebuild, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_removed long, kept_offsets string")


LINES_SQL = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS units FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(units) AS unit, unnest(range(0, len(units))) AS pos FROM split),
s AS (SELECT *, trim(regexp_replace(lower(unit), '[ \t\r\n\f]+', ' ', 'g')) AS norm,
             coalesce(sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u),
r AS (SELECT *, CASE WHEN len(string_split(norm, ' ')) >= 5 THEN row_number() OVER (PARTITION BY md5(norm) ORDER BY doc_id, pos) ELSE 1 END AS rank FROM s),
j AS (SELECT doc_id, coalesce(string_agg(unit, chr(10) ORDER BY pos) FILTER (WHERE rank = 1), '') AS text, CAST(count(*) FILTER (WHERE rank > 1) AS BIGINT) AS n_removed,
             coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE rank = 1), '') AS kept_offsets FROM r GROUP BY doc_id)
SELECT * FROM j UNION ALL SELECT doc_id, text, 0, NULL FROM documents WHERE text IS NULL
"""
