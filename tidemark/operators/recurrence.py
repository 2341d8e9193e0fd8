"""Recurrences y = a * y_before + b along a series as a scan: a series of any length is many tasks.

Rows are dealt by ranges of (key, order), which is the only time that rows are shuffled. A range is walked once, in order, and
written with what its recurrences come to; the rows of its first key, whose series may have begun in a range before, also
get the affine map of the state that comes in. The states between ranges, a row for each, are composed in order and
broadcast. Where series are known to be short, each is walked where it stands, and nothing is dealt by ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import written

#: a, b, and the value that a series begins with at the first row where none of the three is null.
Step = tuple[Column, Column, Column]


def ema(x: Column, span: int) -> Step:
    """Exponential mean; begins with the first value that is there."""
    alpha = 2 / (span + 1)
    return F.when(x.isNotNull(), F.lit(1 - alpha)), x * alpha, x


def smoothed(x: Column, n: int, nth: Column, total: Column) -> Step:
    """Each value has a weight of one n-th; begins at row n - 1 (nth counts from 0) with the mean of the first n, of which total is the sum."""
    there = nth >= n - 1
    return F.when(there, F.lit((n - 1) / n)), F.when(there, x / n), F.when(there, total / n)


def running(x: Column) -> Step:
    """Sum of all values so far; a null counts as zero."""
    x = F.coalesce(x, F.lit(0.0)).cast("double")
    return F.lit(1.0), x, x


def counted() -> Step:
    """The row's place, from 0."""
    return F.lit(1.0), F.lit(1.0), F.lit(0.0)


def _walk(state: float | None, new: list[bool], a: list, b: list, seed: list) -> list[float | None]:
    """The states after each row; a new series has none yet, and a row where a, b or the seed is null leaves the state as it is."""
    out = []
    for n, p, q, s in zip(new, a, b, seed, strict=True):
        if n:
            state = None
        if p == p and q == q and s == s:
            state = s if state is None else p * state + q
        out.append(state)
    return out


def _column(batch: pa.RecordBatch, name: str) -> list:
    """Nulls are nan."""
    return batch.column(name).to_numpy(zero_copy_only=False).astype("float64").tolist()


def _doubles(x: list) -> pa.Array:
    return pa.array(x, pa.float64(), from_pandas=True)


def scan(rows: DataFrame, key: str, order: list[str], steps: dict[str, Step], again: dict[str, tuple[str, int]] | None = None, short: bool = False) -> DataFrame:
    """rows with a column for each of steps: what the recurrence has come to at that row of its key's series, in order of order; null before it begins.

    again: exponential means of what steps have come to: name of the step, span. (key, order) tells rows apart; rows
    without key or with nulls in order aren't of any series, and go. Other columns stay. short: any series may be one
    task; rows that stand in buckets by key aren't shuffled then.
    """
    again, there = again or {}, rows.where(" and ".join(f"`{c}` is not null" for c in (key, *order)))
    if short:
        return _in_place(there, key, order, steps, again)
    out = _ranged(there, key, order, steps)
    return _ranged(out, key, order, {n: ema(F.col(of), span) for n, (of, span) in again.items()}) if again else out


def _inputs(steps: dict[str, Step]) -> list[Column]:
    return [x.cast("double").alias(f"{c}_{i}") for i, step in enumerate(steps.values()) for c, x in zip("abs", step, strict=True)]


def _with(rows: DataFrame, found: DataFrame, names: list[str], y: list[Column]) -> DataFrame:
    return found.select(*[F.col("row")[c].alias(c) for c in rows.columns if c not in names], *[x.alias(n) for n, x in zip(names, y, strict=True)])


def _in_place(rows: DataFrame, key: str, order: list[str], steps: dict[str, Step], again: dict[str, tuple[str, int]]) -> DataFrame:
    once, names = list(steps), [*steps, *again]
    # the window brings a key to one task, in order; where its rows begin, the place is 1
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    made = rows.select(F.struct("*").alias("row"), place.alias("place"), *_inputs(steps))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reached = {n: None for n in names}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            places = batch.column("place").to_numpy()
            new, before = places == 1, np.append(reached, places[:-1])
            if not (new | (places == before + 1)).all():
                raise ValueError("rows of a series aren't in one task, in order")
            reached, new, y = places[-1], new.tolist(), {}
            for i, n in enumerate(once):
                y[n] = _walk(last[n], new, *(_column(batch, f"{c}_{i}") for c in "abs"))
            for n, (of, span) in again.items():
                x, alpha = np.array(y[of], dtype="float64"), 2 / (span + 1)
                y[n] = _walk(last[n], new, [1 - alpha] * len(x), (x * alpha).tolist(), x.tolist())
            last = {n: x[-1] for n, x in y.items()}
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(_doubles(y[n]) for n in names)], ["row", *(f"y_{i}" for i in range(len(names)))])

    kind = made.schema["row"].dataType.simpleString()
    found = made.mapInArrow(walked, ", ".join([f"row {kind}", *(f"y_{i} double" for i in range(len(names)))]))
    return _with(rows, found, names, [F.col(f"y_{i}") for i in range(len(names))])


def _ranged(rows: DataFrame, key: str, order: list[str], steps: dict[str, Step]) -> DataFrame:
    spark, names = rows.sparkSession, list(steps)
    count, parts = len(names), int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = rows.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.struct(*order).alias("at"), *_inputs(steps))
    made = made.repartitionByRange(parts, "key", "at").sortWithinPartitions("key", "at").withColumn("part", F.spark_partition_id())

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, begins, first, last, held = None, None, True, [(None, 1.0, 0.0)] * count, None

        def ended(columns: list, ends: bool) -> pa.RecordBatch:
            """columns with the range's first key in its last row."""
            n, kind = len(columns[0]), columns[1].type
            return pa.RecordBatch.from_arrays([*columns, pa.array([None] * (n - 1) + [begins if ends else None], kind), pa.array([False] * (n - 1) + [ends])], [*kept, *numbers, "first_key", "last"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_pylist()
            new = [x != y for x, y in zip(keys, [keys[0] if before is None else before, *keys[:-1]], strict=True)]
            before, begins, out = keys[-1], keys[0] if begins is None else begins, []
            own = next((i for i, x in enumerate(new) if x), len(new)) if first else 0  # rows of the range's first key
            first = own == len(new)
            for i in range(count):
                a, b, s = (_column(batch, f"{c}_{i}") for c in "abs")
                y = _walk(last[i][0], new, a, b, s)
                p, q, maps = *last[i][1:], ([], [])
                for n in range(own):
                    if a[n] == a[n] and b[n] == b[n] and s[n] == s[n]:
                        p, q = a[n] * p, a[n] * q + b[n]
                    maps[0].append(p)
                    maps[1].append(q)
                last[i] = y[-1], p, q
                out += [_doubles(y), *(_doubles(x + [None] * (len(y) - own)) for x in maps)]
            head = pa.array([True] * own + [False] * (len(new) - own))
            if held:
                yield ended(held, False)
            held = [*(batch.column(c) for c in ("row", "key", "part")), head, *out]
        if held:
            yield ended(held, True)

    def composed(frame: pd.DataFrame) -> pd.DataFrame:
        """The states that come to each range: those of its first key at the end of the range before, if that ended with the same key."""
        out, reached, states = [], None, [None] * count
        for r in frame.sort_values("part").to_dict("records"):
            mine = states if reached == r["first_key"] else [None] * count
            out.append([r["part"], *mine])
            states = []
            for i, came in enumerate(mine):
                y = r[f"y_{i}"]
                if r["first_key"] == r["last_key"] and came is not None:
                    y = r[f"p_{i}"] * came + r[f"q_{i}"]
                states.append(None if y is None or y != y else float(y))
            reached = r["last_key"]
        found = pd.DataFrame(out, columns=["part", *(f"x_{i}" for i in range(count))])
        return found.astype({f"x_{i}": "Float64" for i in range(count)})

    kept, numbers = ["row", "key", "part", "head"], [f"{c}_{i}" for i in range(count) for c in "ypq"]
    kinds = {f.name: f.dataType.simpleString() for f in made.schema.fields} | {"head": "boolean"}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in kept), *(f"{c} double" for c in numbers), f"first_key {kinds['key']}", "last boolean"])
    ranged = written(made.mapInArrow(walked, schema), "series")
    ends = ranged.where("last").select("part", "first_key", F.col("key").alias("last_key"), *numbers)
    # a row for each range
    states = ends.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(composed, ", ".join(["part int", *(f"x_{i} double" for i in range(count))]))
    found = ranged.join(F.broadcast(states), "part", "left")
    came = [F.coalesce(F.when(F.col("head"), F.col(f"p_{i}") * F.col(f"x_{i}") + F.col(f"q_{i}")), F.col(f"y_{i}")) for i in range(count)]
    return _with(rows, found, names, came)
