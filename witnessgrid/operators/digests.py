"""SHA-256 of groups of any size, fed row by row.

The hash of a group is sequential by its nature, so its rows are shuffled to one task, sorted
there by Spark (which spills), and streamed through: the hash state is carried from batch to batch
and nothing of a group is held. Groups are independent, so they spread over the tasks.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .ordered import gathered


def sha256_of(rows: DataFrame, keys: list[str], order: list[str], text: str, prefix: str = "", after: str = "") -> DataFrame:
    """(keys, sha256): hex digest of ``prefix`` and the texts of each group in ``order``, each with ``after`` behind it.

    A null text adds only ``after``; rows equal in ``order`` must have equal texts.
    """
    n = len(keys)
    schema = rows.select(*keys).schema.add("sha256", "string")
    head, tail = prefix.encode(), after.encode()

    def stream(batches):
        state, now, types = None, None, None
        for batch in batches:
            done, types = [], [batch.schema.field(i).type for i in range(n)]
            for *key, value in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or key != now:
                    if state is not None:
                        done.append((*now, state.hexdigest()))
                    state, now = hashlib.sha256(head), key
                state.update((value or "").encode() + tail)
            yield emit(done, types)
        if state is not None:
            yield emit([(*now, state.hexdigest())], types)

    def emit(done, types):
        columns = list(zip(*done)) or [()] * (n + 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [*types, pa.string()])], names=[*keys, "sha256"])
    sorted_rows = gathered(rows.select(*keys, *order, F.col(text).alias("_t")), keys, order)
    return sorted_rows.select(*keys, "_t").mapInArrow(stream, schema)
