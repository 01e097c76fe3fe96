"""Dense arrays from (place, value) pairs, and rows from ranges of positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

#: Places that are filled at once in a task.
AT_ONCE = 1 << 22
#: Positions that one row is spread to in one step.
RUN = 4096


def dense(df: DataFrame, keys: list[str], at: str, size: int, values: dict[str, str]) -> DataFrame:
    """(keys, arrays): for each key, one array of `size` places for every entry of values ({array: column}); places without a row hold 0.

    A key's rows are gathered as pairs and written to their places in one step, so the work is linear in places. Whole-number columns give arrays of longs, others doubles.
    """
    return filled(gathered(df, keys, at, values), keys, size, list(values))


def gathered(df: DataFrame, keys: list[str], at: str, values: dict[str, str]) -> DataFrame:
    """(keys, _at, arrays): for each key the places of its rows, and their values in the same order. What is sorted or shuffled is gathered only, never filled."""
    types = {out: LongType() if isinstance(df.schema[c].dataType, LongType) else DoubleType() for out, c in values.items()}
    pairs = df.groupBy(*keys).agg(F.collect_list(F.struct(F.col(at).alias("_at"), *[F.col(c).cast(types[o]).alias(o) for o, c in values.items()])).alias("_p"))
    return pairs.select(*keys, F.col("_p._at").alias("_at"), *[F.col(f"_p.{o}").alias(o) for o in values])


def summed_in_order(df: DataFrame, keys: list[str], at: str, value: str, name: str) -> DataFrame:
    """gathered, of rows that lie sorted by keys and place inside partitions, with all rows of a key in one: equal places are summed and lists cut in one pass, without a group by."""
    kind = LongType() if isinstance(df.schema[value].dataType, LongType) else DoubleType()
    d = df.select(*keys, F.col(at).cast("long").alias("_at"), F.col(value).cast(kind).alias(name))

    def lists(held):
        t = pa.Table.from_batches(held).combine_chunks()
        cols = [t.column(k).to_numpy() for k in keys]
        where = t.column("_at").to_numpy()
        first = np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])
        cell = first | np.concatenate([[True], where[1:] != where[:-1]])
        starts = np.flatnonzero(cell)
        offsets = pa.array(np.append(np.flatnonzero(first[starts]), len(starts)).astype(np.int32))
        sums = np.add.reduceat(t.column(name).to_numpy(), starts)
        arrays = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (where[starts], sums)]
        return pa.RecordBatch.from_arrays([pa.array(c[first]) for c in cols] + arrays, [*keys, "_at", name])

    def run(batches):
        held = []  # rows of the last key so far: it may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy() for k in keys]
            other = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in cols]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut or (held and any(h != c[0] for h, c in zip((held[-1].column(k)[-1].as_py() for k in keys), cols))):
                yield lists([*held, b.slice(0, cut)])
                held = []
            held.append(b.slice(cut))
        if held:
            yield lists(held)

    schema = StructType([*d.select(*keys).schema.fields]).add("_at", ArrayType(LongType())).add(name, ArrayType(kind))
    return d.mapInArrow(run, schema)


def filled(pairs: DataFrame, keys: list[str], size: int, values: list[str]) -> DataFrame:
    """(keys, arrays) with `size` places each, from gathered rows."""
    pairs = pairs.select(*keys, "_at", *values)
    types = {o: pairs.schema[o].dataType.elementType for o in values}

    def run(batches):
        step = max(1, AT_ONCE // max(size, 1))
        for b in batches:
            for i in range(0, b.num_rows, step):
                c = b.slice(i, step)
                n = c.num_rows
                where = c.column("_at")
                place = np.repeat(np.arange(n), np.diff(where.offsets.to_numpy())) * size + where.flatten().to_numpy()
                cols = [c.column(k) for k in keys]
                for o in values:
                    out = np.zeros(n * size, np.int64 if isinstance(types[o], LongType) else np.float64)
                    out[place] = c.column(o).flatten().to_numpy()
                    cols.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(out)))
                yield pa.RecordBatch.from_arrays(cols, [*keys, *values])

    schema = StructType([*pairs.select(*keys).schema.fields])
    for o, t in types.items():
        schema = schema.add(o, ArrayType(t))
    return pairs.mapInArrow(run, schema)


def spread(df: DataFrame, start: str, past: str, name: str) -> DataFrame:
    """One row for each whole number from start up to past (not included), in runs, so that no long range is an array; start and past are dropped."""
    d = df.where(F.col(past) > F.col(start)).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(past) - F.col(start) - 1) / RUN))))
    lo = F.col(start) + F.col("_run") * RUN
    return d.withColumn(name, F.explode(F.sequence(lo, F.least(F.col(past), lo + RUN) - 1))).drop("_run", start, past)
