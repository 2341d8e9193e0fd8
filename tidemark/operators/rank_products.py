"""Products of exact ranks of several columns, of all rows and of those of either of two kinds, without a shuffle of rows.

Rows are cut into blocks where they are read. A block sends its distinct values of a column, in order and with their counts,
to the ranges of values that hold them; a range merges what all blocks sent and sends back the ranks of each block's values,
in the same order. So no value travels with an id: a block keeps for each row the place of its value among the block's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import written

#: Rows of a block, and values of all blocks that a range has at about, which one task holds at once.
BLOCK, RANGE = 1 << 18, 1 << 20
#: Values that have so many digits after the point at most take less space.
DIGITS = 9
COUNTS = ("n", "first", "second")


def packed(*columns: np.ndarray) -> bytes:
    """Whole numbers, compressed; their first bytes stand together, then their second ones: small numbers take little space."""
    sizes = np.array([len(columns), *map(len, columns)], "<i8").tobytes()
    planes = b"".join(np.ascontiguousarray(c, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return sizes + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    sizes = np.frombuffer(data, "<i8", n, 8)
    planes = np.frombuffer(pa.decompress(data[8 * (n + 1) :], int(sizes.sum()) * 8, "zstd", asbytes=True), np.uint8)
    return [np.ascontiguousarray(x.reshape(8, -1).T).view("<i8").ravel() for x in np.split(planes, np.cumsum(sizes[:-1]) * 8)]


def steps(values: np.ndarray) -> np.ndarray:
    """Whole numbers in order as differences, of which np.cumsum makes them again, also where they overflow."""
    return np.diff(values, prepend=np.int64(0))


def whole(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles in order as a scale (0: none) and whole numbers in the same order, of which doubles() makes exactly them."""
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.rint(values * 10.0**DIGITS)
    if (np.abs(scaled) < 2**52).all() and (scaled / 10.0**DIGITS == values).all():
        return np.array([DIGITS]), scaled.astype(np.int64)
    bits = values.view(np.int64)
    return np.array([0]), bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def doubles(scale: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return numbers / 10.0 ** int(scale[0]) if scale[0] else (numbers ^ ((numbers >> 63) & np.int64(2**63 - 1))).view(np.float64)


def _sent(block: int, kind: np.ndarray, columns: list[np.ndarray], cuts: list[np.ndarray]) -> pa.RecordBatch:
    """What a block sends: its values and counts by column and range, and for itself (k = -1) the kinds and places of its rows."""
    rows, places = [], []
    for k, values in enumerate(columns):
        found, place = np.unique(values, return_inverse=True)
        counts = [np.bincount(place[own], minlength=len(found)) for own in (slice(None), kind == 1, kind == 2)]
        ends = [0, *np.searchsorted(found, cuts[k]), len(found)]
        for part, (low, high) in enumerate(zip(ends, ends[1:], strict=False)):
            if low < high:
                scale, numbers = whole(found[low:high])
                own = [c[low:high] for c in counts]
                rows.append((block, k, part, *[int(c.sum()) for c in own], packed(scale, steps(numbers), *own)))
        places.append(place)
    rows.append((block, -1, 0, len(kind), int((kind == 1).sum()), int((kind == 2).sum()), packed(kind, *places)))
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["block", "k", "part", *COUNTS, "data"])


def _blocks(cuts: list[np.ndarray], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, n, nth = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            if any(c.null_count for c in batch.columns):
                raise ValueError("null has no rank")
            while batch.num_rows:
                held.append(batch.slice(0, size - n))
                batch, n = batch.slice(size - n), n + held[-1].num_rows
                if n == size:
                    yield block(first + nth, held)
                    held, n, nth = [], 0, nth + 1
        if held:
            yield block(first + nth, held)

    def block(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        kind, *columns = [c.to_numpy() for c in pa.Table.from_batches(held).columns]
        return _sent(number, kind, columns, cuts)

    return run


def _ranked(sent: pa.Table) -> pa.Table:
    """Of a range, the ranks of each block's values: doubled, less their mean, of all rows and of those of either kind that the block has."""
    each = [unpacked(x.as_py()) for x in sent["data"]]
    ends = np.cumsum([len(x[1]) for x in each])
    values, place = np.unique(np.concatenate([doubles(scale, np.cumsum(numbers)) for scale, numbers, *_ in each]), return_inverse=True)
    ranks = []
    for i, name in enumerate(COUNTS):
        own = np.concatenate([x[2 + i] for x in each])
        n = np.bincount(place, own, len(values)).astype(np.int64)
        rank = sent[f"start_{name}"][0].as_py() + 2 * (np.cumsum(n) - n) + n
        ranks.append([steps(r[c > 0]) for r, c in zip(np.split(rank[place], ends[:-1]), np.split(own, ends[:-1]), strict=True)])
    data = [packed(*x) for x in zip(*ranks, strict=True)]
    return pa.table({"block": sent["block"], "k": sent["k"], "part": sent["part"], "data": pa.array(data, pa.binary())})


def _products(names: list[str]):
    def run(own: pa.Table) -> pa.Table:
        found = {(k, part): unpacked(x) for k, part, x in zip(own["k"].to_pylist(), own["part"].to_pylist(), own["data"].to_pylist(), strict=True)}
        kind, *places = found.pop((-1, 0))
        rows = []
        for i in range(len(COUNTS)):
            mine = slice(None) if i == 0 else kind == i
            ranks = np.empty((len(places), len(kind[mine])))
            for k, place in enumerate(places):
                there = np.bincount(place[mine], minlength=place.max() + 1) > 0
                rank = np.empty(len(there))
                rank[there] = np.concatenate([np.cumsum(found[at][i]) for at in sorted(found) if at[0] == k])
                ranks[k] = rank[place[mine]]
            if ranks.size:
                products = ranks @ ranks.T
                rows.append((i, *[products[a, b] for a in range(len(names)) for b in range(a, len(names))]))
        columns = list(zip(*rows, strict=True))
        return pa.table({"kind": pa.array(columns[0], pa.int32()), **{c: pa.array(x, pa.float64()) for c, x in zip(_pairs(names), columns[1:], strict=True)}})

    return run


def _pairs(names: list[str]) -> list[str]:
    return [f"{a}_{b}" for a in range(len(names)) for b in range(a, len(names))]


def rank_products(rows: DataFrame, names: list[str]) -> DataFrame:
    """kind, and for columns number a <= b of names a_b: the sum over rows of the product of both ranks, which are doubled and less their mean; ties have their mean rank.

    rows: kind (1 or 2, or 0 for rows of neither), names (doubles, not null). Kind 0 of the result is of all rows; a kind without rows isn't there.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(F.col("kind").cast("long").alias("kind"), *names)
    # only bounds of about equal ranges, by which work is dealt; ranks follow from all values
    ranges = max(-(-parts // len(names)), -(-rows.count() // RANGE))
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)]) if ranges > 1 else None
    bounds = rows.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in names]).first() if shares is not None else None
    cuts = [np.unique(np.array((bounds[c] if bounds else None) or [], float)) for c in names]
    sent = "block long, k int, part int, " + ", ".join(f"{n} long" for n in COUNTS) + ", data binary"
    blocks = written(rows.mapInArrow(_blocks(cuts, BLOCK), sent), "rank-blocks")
    values = blocks.where("k >= 0")
    sums = values.groupBy("k", "part").agg(*[F.sum(n).alias(n) for n in COUNTS])  # a row for each range
    before, of_all = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("k")
    start = lambda n: (2 * F.coalesce(F.sum(n).over(before), F.lit(0)) - F.sum(n).over(of_all)).alias(f"start_{n}")
    values = values.select("block", "k", "part", "data").join(F.broadcast(sums.select("k", "part", *map(start, COUNTS))), ["k", "part"])
    own = "block long, k int, part int, data binary"
    ranked = values.repartition(parts, "k", "part").groupBy("k", "part").applyInArrow(_ranked, own)
    both = ranked.unionByName(blocks.where("k < 0").select("block", "k", "part", "data"))
    each = both.repartition(parts, "block").groupBy("block").applyInArrow(_products(names), "kind int, " + ", ".join(f"`{c}` double" for c in _pairs(names)))
    return each.groupBy("kind").agg(*[F.sum(f"`{c}`").alias(c) for c in _pairs(names)])
