"""Exact dedup by content sort.

Sampled splitters range-partition the rows on (prefix of the normalised bytes, their SHA-256, id), so
equal texts are adjacent in the global order and a group of copies of any size is split over as many
partitions as its rows need. External sorting orders each partition; one pass compares neighbours on
the full normalised bytes. Only a run that touches a partition's edge can continue in another
partition: two summaries a partition at most, a table bounded by the number of partitions, which is
broadcast to join such runs.

Edge cases: a null text counts as empty, so all null and empty texts are one group. A null id sorts
last and stays only if its whole group has null ids. Of repeated rows (same id and text) one is kept.
An empty table gives an empty result. Other columns are carried only if asked, under any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.llm.common import materialize

PREFIX_BYTES = 32


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the sort key of each text."""
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "")
        normal = pc.ascii_lower(texts).cast(pa.binary())
        key = pa.array([hashlib.sha256(x.as_buffer()).digest() for x in normal], pa.binary())
        head = pc.binary_slice(normal, 0, PREFIX_BYTES) if len(normal) else normal
        yield pa.RecordBatch.from_arrays([head, key, *batch.columns], ["head", "sha", *batch.schema.names])


def _runs(carry: Sequence[str]):
    """Over one sorted partition: finds runs of equal texts by comparing neighbours."""

    def close(rows: list[pa.Table], edge: int, pid: int) -> pa.Table:
        table = pa.concat_tables(rows)
        ids = table.column("doc_id")
        n = len(table)
        first = ids[0].as_py()  # ids are sorted with the one to keep first
        return pa.table([ids, table.column("sha"), table.column("first"), pa.array([first] * n, pa.int64()), pa.array(np.full(n, n, np.int64)), pa.array(np.full(n, edge, np.int32)), pa.array(np.full(n, pid, np.int32)), *(table.column(c) for c in carry)], names=["doc_id", "sha", "first", "local_keep", "local_size", "edge", "pid", *carry])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        open_rows: list[pa.Table] = []
        last_sha, last_text, at_start = None, None, True
        for batch in batches:
            if not len(batch):
                continue
            sha = batch.column("sha")
            normal = pc.ascii_lower(pc.fill_null(batch.column("text"), "")).cast(pa.binary())
            n = len(batch)
            new = np.ones(n, bool)
            new[1:] = pc.fill_null(pc.not_equal(sha.slice(1), sha.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(~new):  # the same digest: compare whole texts
                new[i] = normal[int(i)] != normal[int(i) - 1]
            new[0] = last_sha is None or sha[0].as_py() != last_sha or normal[0].as_py() != last_text
            mask = pa.array(new)
            table = pa.table([batch.column("doc_id"), sha, mask, *(pc.if_else(mask, batch.column(c), pa.scalar(None, batch.column(c).type)) for c in carry)], names=["doc_id", "sha", "first", *carry])
            cuts = np.flatnonzero(new)
            last_sha, last_text = sha[n - 1].as_py(), normal[n - 1].as_py()
            if not len(cuts):
                open_rows.append(table)
                continue
            if cuts[0] > 0:
                open_rows.append(table.slice(0, cuts[0]))
            if open_rows:
                yield from close(open_rows, 1 if at_start else 0, pid).combine_chunks().to_batches()
                at_start = False
            middle = cuts[-1] - cuts[0]
            if middle:  # runs that begin and end in this batch
                part = table.slice(cuts[0], middle)
                sizes = np.diff(cuts)
                of = np.repeat(np.arange(len(sizes)), sizes)
                keep = part.column("doc_id").take(pa.array((cuts[:-1] - cuts[0])[of]))
                edge = np.zeros(middle, np.int32)
                if at_start:
                    edge[: sizes[0]] = 1
                    at_start = False
                out = pa.table([part.column("doc_id"), part.column("sha"), part.column("first"), keep, pa.array(sizes[of].astype(np.int64)), pa.array(edge), pa.array(np.full(middle, pid, np.int32)), *(part.column(c) for c in carry)], names=["doc_id", "sha", "first", "local_keep", "local_size", "edge", "pid", *carry])
                yield from out.combine_chunks().to_batches()
            open_rows = [table.slice(cuts[-1])]
        if open_rows:
            yield from close(open_rows, 3 if at_start else 2, pid).combine_chunks().to_batches()

    return over


def exact_dedup(docs: DataFrame, keep: str = "smallest", carry: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id (id of the row that stays), group_size, kept, text_sha256
    (of the text with A-Z lower-cased). keep: the "smallest" or "largest" id of equal texts stays.
    carry: columns of docs that the kept rows also return (null in dropped rows)."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    names = [f"carry_{i}" for i in range(len(carry))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(n) for c, n in zip(carry, names, strict=True)))
    keyed = rows.mapInArrow(_keyed, T.StructType([T.StructField("head", T.BinaryType()), T.StructField("sha", T.BinaryType()), *rows.schema.fields]))
    by_id = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    order = [F.col("head"), F.col("sha"), by_id]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    fields = "doc_id long, sha binary, first boolean, local_keep long, local_size long, edge int, pid int"
    schema = T.StructType([*T.StructType.fromDDL(fields).fields, *(T.StructField(n, rows.schema[n].dataType) for n in names)])  # null in dropped rows
    runs = materialize(dealt.mapInArrow(_runs(names), schema), "exact-runs")
    edges = runs.where("edge > 0 AND first").groupBy("sha").agg(F.sum("local_size").alias("all_size"), F.min_by("local_keep", "pid").alias("all_keep"), F.min("pid").alias("first_pid"))
    # at most two runs a partition touch an edge, so this table is bounded by the number of partitions
    found = runs.join(F.broadcast(edges.withColumnRenamed("sha", "edge_sha")), (F.col("edge") > 0) & (F.col("sha") == F.col("edge_sha")), "left")
    at_edge = F.col("edge_sha").isNotNull()
    return found.select(
        "doc_id",
        F.when(at_edge, F.col("all_keep")).otherwise(F.col("local_keep")).alias("keep_id"),
        F.when(at_edge, F.col("all_size")).otherwise(F.col("local_size")).alias("group_size"),
        (F.col("first") & (~at_edge | (F.col("pid") == F.col("first_pid")))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *(F.col(n).alias(f"_{n}") for n in names),
    )


def drop_exact_duplicates(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    found = exact_dedup(docs, keep, docs.columns, id_col, text_col).where("kept")
    return found.select(*(F.col(f"_carry_{i}").alias(c) for i, c in enumerate(docs.columns)))
