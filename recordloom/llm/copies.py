"""Exact copies behind formatting differences.

Every record is brought to a canonical key; records are range-partitioned and
sorted by the whole key, and each run of equal neighbouring keys gives one
representative and the number of its copies.

Before anything is shuffled each task folds the copies in its own batches, so a
record that makes up a third of all rows reaches the range partition that owns it
as a few partial counts. The range exchange and the external sort are Spark's own
operators and spill to disk; the scan over adjacent runs keeps one open run.

Defined cases: a null record is no record and gives no row; a text without any of
the four fields is its own record by its letters and digits; a field that is
missing equals an empty one; of a field written twice the first counts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.session import cut

#: The fields that identify a call in a dump.
KEY_FIELDS = ("number", "date", "duration", "type")
#: What a comparison ignores: blanks, control characters and punctuation, the ASCII signs included; not the separator of fields.
IGNORED = r"[\s\p{Z}\p{C}\p{P}$+<=>^`|~&&[^\x1f]]+"
_ASCII_IGNORED = "".join(chr(c) for c in range(128) if not chr(c).isalnum() and c != 0x1F)
_FIELD = r"""(?s)(?<![\p{L}\p{N}_])(number|date|duration|type)["']?\s*[=:]\s*("[^"]*"|'[^']*'|[^"'\s,;>}][^\s,;>}]*)"""


def keyed_records(records: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """key, id, n = 1 of each record; copies of a record have equal keys.

    One expression a step, so that none is evaluated twice a row. ASCII signs go by
    translation; the regular expression for all others runs only where there are any.
    """
    text = F.lower(F.translate(text_column, "\x1f", " "))
    rows = records.where(F.col(text_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("id"), text.alias("text"))
    found = rows.select("id", "text", F.regexp_extract_all("text", F.lit(_FIELD), F.lit(1)).alias("names"), F.regexp_extract_all("text", F.lit(_FIELD), F.lit(2)).alias("values"))
    fields = [F.coalesce(F.try_element_at("values", F.nullif(F.array_position("names", F.lit(f)).cast("int"), F.lit(0))), F.lit("")) for f in KEY_FIELDS]
    said = found.select("id", F.when(F.size("names") > 0, F.concat_ws("\x1f", *fields)).otherwise(F.col("text")).alias("said"))
    plain = said.select("id", "said", F.translate("said", _ASCII_IGNORED, "").alias("plain"))
    only_ascii = F.octet_length("plain") == F.length("plain")
    return plain.select(F.when(only_ascii, F.col("plain")).otherwise(F.regexp_replace("plain", IGNORED, "")).alias("key"), "id", F.lit(1).cast("bigint").alias("n"))


def fold_batches(df: DataFrame) -> DataFrame:
    """Adds up equal keys (columns key, id, n) within each batch of a task, without a shuffle."""

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by("key", use_threads=False).aggregate([("id", "min"), ("n", "sum")])
            table = table.select(["key", "id_min", "n_sum"]).rename_columns(["key", "id", "n"])
            yield from table.cast(pa.schema([("key", pa.string()), ("id", pa.int64()), ("n", pa.int64())])).to_batches()

    return df.mapInArrow(fold, "key string, id bigint, n bigint")


def scan_runs(ordered: DataFrame) -> DataFrame:
    """key, id, copies of each run of equal neighbouring keys in sorted partitions (columns key, id, n).

    A run is carried over the borders of batches; of each batch only the places
    where the key changes are looked at.
    """

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def rows(keys, ids, counts):
            return pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], names=["key", "id", "copies"])

        open_key, open_id, open_n = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids, counts = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            change = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False) if len(keys) > 1 else np.zeros(0, bool)
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            least, total = np.minimum.reduceat(ids, starts), np.add.reduceat(counts, starts)
            if open_key is not None:
                if keys[0].as_py() == open_key:
                    least[0], total[0] = min(least[0], open_id), total[0] + open_n
                else:
                    yield rows(pa.array([open_key], pa.string()), [open_id], [open_n])
            if len(starts) > 1:
                yield rows(keys.take(pa.array(starts[:-1])).cast(pa.string()), least[:-1], total[:-1])
            open_key, open_id, open_n = keys[int(starts[-1])].as_py(), int(least[-1]), int(total[-1])
        if open_key is not None:
            yield rows(pa.array([open_key], pa.string()), [open_id], [open_n])

    return ordered.mapInArrow(scan, "key string, id bigint, copies bigint")


def collapse(records: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per record: key, id (the smallest of its copies), copies.

    The folded keys are written once, since a range exchange reads its input twice
    (for the borders of the ranges and for the rows).
    """
    folded = cut(fold_batches(keyed_records(records, id_column, text_column)))
    return scan_runs(folded.repartitionByRange("key").sortWithinPartitions("key"))


def found(records: DataFrame) -> DataFrame:
    """dump_id, copies of every record of ``call_dump`` with two or more rows."""
    return collapse(records, "dump_id", "record_text").where("copies >= 2").select(F.col("id").alias("dump_id"), "copies")
