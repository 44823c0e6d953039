"""Canonical JSON and the hash chains built on it, recomputed from the entries' contents."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import sliced, written
from .ordering import total_order
from .records import GENESIS

#: An entry's fields in its hash (fixed), besides its version 1 and the parsed details.
FIELDS = ["case_id", "seq", "timestamp_utc", "action", "evidence_id", "examiner", "tool_version", "ntp_status", "prev_hash"]
#: JSON text with keys sorted, no blanks, everything beyond ASCII escaped.
dumped = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode


def canonical(text: Column | str) -> Column:
    """JSON text in canonical form; null where it can't be parsed."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                return None if x is None else dumped(json.loads(x))
            except ValueError:
                return None

        return rows.map(one)

    return run(text)


def entry_hashes(log: DataFrame) -> DataFrame:
    """log with `computed`: the SHA-256 of each entry's canonical JSON; null where its details can't be parsed."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out: list[str | None] = []
            for details, *values in zip(*(b.column(c).to_pylist() for c in ("details_json", *FIELDS))):
                try:
                    parsed = json.loads(details)
                except (TypeError, ValueError):
                    out.append(None)
                    continue
                out.append(hashlib.sha256(dumped({"v": 1, "details": parsed} | dict(zip(FIELDS, values))).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "computed"])

    return log.mapInArrow(run, f"{kinds}, computed string")


def chain_report(log: DataFrame, key_id: str) -> DataFrame:
    """(case_id, seq, reason): what is wrong with each entry; signatures aside.

    log: FIELDS, details_json, entry_hash, key_id; a case's seqs differ. Places come from one order over all logs, so no
    case is in one window, and the entry before is met by a join. Entries are hashed once they are in order: to order them
    reads them twice, for a sample of the ranges and for the rows.
    """
    placed = total_order(log.select(*FIELDS, "details_json", "entry_hash", "key_id"), [F.col("case_id"), F.col("seq")], "at")
    own = written(entry_hashes(placed).select("case_id", "seq", "at", "prev_hash", "entry_hash", "key_id", "computed"))
    first = own.groupBy("case_id").agg(F.min("at").alias("first"))
    last = own.select((F.col("at") + 1).alias("at"), F.col("case_id").alias("last_case"), F.col("entry_hash").alias("last_hash"))
    rows = own.join(first, "case_id").join(last, "at", "left").withColumn("due", F.col("at") - F.col("first") + 1)
    before = F.when(F.col("last_case") == F.col("case_id"), F.col("last_hash")).otherwise(F.lit(GENESIS))
    faults = F.array_compact(
        F.array(
            F.when(F.col("seq") != F.col("due"), F.concat(F.lit("sequence gap or reorder (expected "), F.col("due").cast("string"), F.lit(")"))),
            F.when(~F.col("prev_hash").eqNullSafe(before), "prev_hash does not match previous entry_hash"),
            F.when(F.col("computed").isNull(), "details not parseable"),
            F.when(F.col("computed").isNotNull() & ~F.col("computed").eqNullSafe(F.col("entry_hash")), "entry_hash does not match entry contents"),
            F.when(~F.col("key_id").eqNullSafe(F.lit(key_id)), F.concat(F.lit("signed with unknown key "), F.coalesce("key_id", F.lit("None")))),
        )
    )
    return rows.select("case_id", "seq", F.explode(faults).alias("reason"))
