"""Groups that share a key, dealt to tasks in cells of bounded size.

A group beyond a limit is cut into chunks by the hash of its members; each pair of chunks is a cell, so that every
pair of members still meets in exactly one cell, and no task holds a large group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.shared import bounded, discard, stored


def dealt(rows: DataFrame, key: str, member: str, limit: int) -> DataFrame:
    """Adds ``cell`` (long, the hash of key and chunk pair), ``chunk`` and ``other`` (ints; a cell pairs its two
    chunks, or one chunk with itself), deals rows by cell and sorts each partition by it. Cells may collide: compare
    keys where that matters. Members of a chunk appear once for each chunk that theirs is paired with."""
    large = stored(rows.groupBy(key).count().where(F.col("count") > limit).select(key, F.ceil(F.col("count") / limit).cast("int").alias("chunks")), "large-groups")
    n = large.count()
    if n:
        rows = rows.join(bounded(large, n), key, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), member), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    else:
        discard(large)
        rows = rows.withColumn("chunk", F.lit(0)).withColumn("other", F.lit(0))
    rows = rows.withColumn("cell", F.xxhash64(key, F.least("chunk", "other"), F.greatest("chunk", "other")))
    return rows.repartition("cell").sortWithinPartitions("cell")


def cell_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole cells with the cells' starts and ends, from batches sorted by cell."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column("cell").to_numpy()
        if kept and cells[0] == cells[-1] == kept[0].column("cell")[-1].as_py():
            kept.append(batch)  # still inside one large cell
            continue
        cut = int(np.searchsorted(cells, cells[-1]))
        if cut or (kept and kept[0].column("cell")[-1].as_py() != cells[0]):
            yield _whole([*kept, batch.slice(0, cut)])
            kept = [batch.slice(cut)]
        else:
            kept.append(batch)
    if kept:
        yield _whole(kept)


def _whole(batches: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    table = pa.Table.from_batches([b for b in batches if b.num_rows] or batches[:1])
    cells = table.column("cell").to_numpy()
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(cells)), bool), cells[1:] != cells[:-1])))
    return table, starts, np.append(starts[1:], len(cells)).astype(starts.dtype) if len(starts) else starts
