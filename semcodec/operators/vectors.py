"""Sums and means of vectors by key: partial sums in each task, one row for each key and task shuffled, and a merge of sorted rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that a task holds before it sends its sums on.
HELD = 4_000_000


def matrix(col: pa.Array) -> np.ndarray:
    """A column of lists of one length, none of them null, as rows of numbers."""
    flat = np.asarray(col.flatten()).astype(np.float64)
    if len(col) and len(flat) % len(col) or len(col) and not np.all(np.diff(col.offsets.to_numpy()) == len(flat) // len(col)):
        raise ValueError("vectors of several lengths")
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and which rows have a length at all."""
    norm = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.where(norm > 0, norm, 1)[:, None], norm > 0


def _batch(keys: pa.Array, sums: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    width = sums.shape[1] if sums.ndim == 2 else 0
    begins = np.arange(len(n) + 1, dtype=np.int32) * width
    return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(begins), pa.array(sums.ravel())), pa.array(n)], ["key", "sums", "n"])


def _partial(as_units: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size, kind = 0, None
        for b in batches:
            kind = b.column(0).type
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                keys = part.column(0).dictionary_encode(null_encoding="encode")
                rows, at = matrix(part.column(1)), np.asarray(keys.indices)
                if as_units:
                    rows, there = units(rows)
                    rows, at = rows[there], at[there]
                sums = np.zeros((len(keys.dictionary), rows.shape[1]))
                np.add.at(sums, at, rows)
                n = np.bincount(at, minlength=len(sums))
                for k, key in enumerate(keys.dictionary.to_pylist()):
                    if n[k]:
                        if key in held:
                            held[key] = (held[key][0] + sums[k], held[key][1] + int(n[k]))
                        else:
                            held[key] = (sums[k], int(n[k]))
                            size += sums.shape[1]
                if size > HELD:
                    yield _batch(pa.array(list(held), kind), np.stack([s for s, _ in held.values()]), np.array([n for _, n in held.values()], np.int64))
                    held, size = {}, 0
        if held:
            yield _batch(pa.array(list(held), kind), np.stack([s for s, _ in held.values()]), np.array([n for _, n in held.values()], np.int64))

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: those of one key added up, over the ends of batches as well."""
    open_key, open_sum, open_n = None, None, 0
    kind = None
    for b in batches:
        if not b.num_rows:
            continue
        kind = b.column(0).type
        keys, rows, n = b.column(0).to_pylist(), matrix(b.column(1)), b.column(2).to_numpy()
        begins = np.flatnonzero([k == 0 or keys[k] != keys[k - 1] for k in range(len(keys))])
        sums, counts, own = np.add.reduceat(rows, begins, axis=0), np.add.reduceat(n, begins), [keys[k] for k in begins]
        if open_sum is not None:
            if open_key == own[0]:
                sums[0] += open_sum
                counts[0] += open_n
            else:
                yield _batch(pa.array([open_key], kind), open_sum[None], np.array([open_n]))
        if len(own) > 1:
            yield _batch(pa.array(own[:-1], kind), sums[:-1], counts[:-1])
        open_key, open_sum, open_n = own[-1], sums[-1], int(counts[-1])
    if open_sum is not None:
        yield _batch(pa.array([open_key], kind), open_sum[None], np.array([open_n]))


def means(rows: DataFrame, key: str, column: str, *, as_units: bool = False) -> DataFrame:
    """(key, mean) of the vectors of each key (of their unit vectors; those without length are left out); vectors are of one length, null ones are left out."""
    some = rows.where(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("vector"))
    schema = f"key {some.schema['key'].dataType.simpleString()}, sums array<double>, n long"
    sums = some.mapInArrow(_partial(as_units), schema).repartition("key").sortWithinPartitions("key").mapInArrow(_merge, schema)
    return sums.select(F.col("key").alias(key), F.transform("sums", lambda x: x / F.col("n")).alias("mean"))
