"""Percentiles of very large numeric columns by deterministic buffer collapsing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buffers of one weight that are collapsed into one of FAN times the weight.
FAN = 8
#: Rows that are dealt to their groups at once.
ROWS = 500_000
#: Collapses on top of each other for which the error is stated: values per group up to FAN**LEVELS buffers.
LEVELS = 10


def buffer_size(eps: float) -> int:
    """Values per buffer so that a rank is off by at most eps * n: each of at most LEVELS levels of collapses adds
    half a position of the collapsed buffers, n / (2 * size) in all."""
    return int(np.ceil((LEVELS + 1) / (2 * eps)))


class Sketch:
    """Weighted sorted buffers of one group. levels: weight -> list of (values, error); all buffers of a weight over
    one hold exactly `size` values, those of weight one any number."""

    def __init__(self, size: int):
        self.size, self.loose, self.held, self.full = size, [], 0, {}

    def add(self, values: np.ndarray, weight: int = 1, error: int = 0) -> None:
        if weight == 1:
            self.loose.append(values)
            self.held += len(values)
            if self.held >= self.size * FAN:
                self._pack()
        else:
            self.full.setdefault(weight, []).append((values, error))
            self._collapse(weight)

    def _pack(self) -> None:
        """Makes full buffers of the loose values, in the order they came, and collapses them."""
        rest = np.concatenate(self.loose) if self.loose else np.empty(0)
        n = len(rest) // self.size
        for i in range(n):
            self.full.setdefault(1, []).append((np.sort(rest[i * self.size : (i + 1) * self.size]), 0))
        self.loose = [rest[n * self.size :]]
        self.held = len(self.loose[0])
        if n:
            self._collapse(1)

    def _collapse(self, weight: int) -> None:
        while len(buffers := self.full.get(weight, [])) >= FAN:
            group, self.full[weight] = buffers[:FAN], buffers[FAN:]
            merged = np.sort(np.concatenate([v for v, _ in group]))
            # evenly spaced positions, the middle one of every FAN; the value at each stands for FAN values of `weight`
            kept = merged[FAN // 2 - 1 :: FAN] if len(self.full.get(weight * FAN, [])) % 2 else merged[FAN // 2 :: FAN]
            # its true rank is off by at most half the new weight, besides what the group was off by
            self.full.setdefault(weight * FAN, []).append((kept, sum(e for _, e in group) + weight * FAN // 2))
            weight *= FAN

    def rows(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(weight, error, values) of all buffers."""
        self._pack()
        for w, buffers in sorted(self.full.items()):
            for values, error in buffers:
                yield w, error, values
        if len(self.loose[0]):
            yield 1, 0, np.sort(self.loose[0])

    def quantiles(self, qs: list[float]) -> tuple[int, int, list[float]]:
        """n, the bound on the rank error, and for each q the value at rank ceil(q * n), at least the first."""
        rows = list(self.rows())
        values = np.concatenate([v for _, _, v in rows])
        weights = np.concatenate([np.full(len(v), w) for w, _, v in rows])
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weights[order])
        n = int(upto[-1])
        at = [int(np.searchsorted(upto, max(1, np.ceil(q * n)))) for q in qs]
        widest = max(w for w, _, _ in rows)
        return n, sum(e for _, e, _ in rows) + (widest // 2 if widest > 1 else 0), [float(values[order][i]) for i in at]


_SCHEMA = "weight bigint, error bigint, vals array<double>"


def sketches(df: DataFrame, keys: list[str], value: str, eps: float = 0.005) -> DataFrame:
    """(*keys, part, weight, error, vals): buffers of each group, made in each input partition without a shuffle.

    These rows are what is kept per day, per file or per partition: any union of them is merged by merge_sketches().
    Null and NaN values are no values; infinite ones, zero and negative ones are. A null key is a group. vals are
    sorted; a buffer stands for weight * size(vals) values, exactly as many as it was made of.
    """
    size = buffer_size(eps)
    number = F.col(value).cast("double")
    picked = df.select(*[F.col(k) for k in keys], number.alias("_v")).where("_v is not null and not isnan(_v)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple, Sketch] = {}

        def take(some: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(some)
            vals = table["_v"].to_numpy()
            codes = np.zeros(len(vals), dtype=np.int64)
            uniq: list[list] = []
            for k in keys:
                enc = pa.chunked_array([table[k].combine_chunks()]).combine_chunks().dictionary_encode(null_encoding="encode")
                uniq.append(enc.dictionary.to_pylist())
                codes = codes * len(uniq[-1]) + enc.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            for idx in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
                if len(idx):
                    c, key = int(codes[idx[0]]), []
                    for u in reversed(uniq):
                        key.append(u[c % len(u)])
                        c //= len(u)
                    open_.setdefault(tuple(reversed(key)), Sketch(size)).add(vals[idx])

        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= ROWS:
                take(held)
                held, rows = [], 0
        if held:
            take(held)
        out = [(key, w, e, v) for key, s in open_.items() for w, e, v in s.rows()]
        if out:
            # pieces of bounded size
            for i in range(0, len(out), 500):
                some = out[i : i + 500]
                arrays = [pa.array([r[0][j] for r in some], type=types[j]) for j in range(len(keys))]
                arrays += [pa.array([r[1] for r in some], pa.int64()), pa.array([r[2] for r in some], pa.int64()), pa.array([r[3] for r in some], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, [*keys, "weight", "error", "vals"])

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(picked.schema[k].dataType) for k in keys]
    schema = ", ".join(f"`{k}` {picked.schema[k].dataType.simpleString()}" for k in keys) + ", " + _SCHEMA
    return picked.mapInArrow(run, schema).withColumn("part", F.spark_partition_id())


def _gathered() -> Column:
    """A group's buffers in one row: a few per level of collapses, of a fixed size, from a fixed number of sketches."""
    return F.collect_list(F.struct("weight", "error", "vals")).alias("b")


def _buffers(column: pa.Array) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Per row of an array of (weight, error, vals) its buffers."""
    ends, flat = column.offsets.to_numpy(), column.values
    weight, error, vals = flat.field("weight").to_numpy(), flat.field("error").to_numpy(), flat.field("vals")
    at, values = vals.offsets.to_numpy(), vals.values.to_numpy(zero_copy_only=False)
    for a, z in zip(ends[:-1], ends[1:]):
        yield [(int(weight[i]), int(error[i]), values[at[i] : at[i + 1]]) for i in range(a, z)]


def merge_sketches(buffers: DataFrame, keys: list[str], eps: float = 0.005, fan_in: int = 64, parts: int | None = None) -> DataFrame:
    """Buffers of the same form, merged per group by a tree: parts are merged fan_in at a time until one is left, so
    that no task holds more than fan_in sketches of a group. parts is the number of parts, if known; errors add up
    and the collapses of a merge add theirs, as in one sketch over all values."""
    size = buffer_size(eps)
    left = parts if parts is not None else buffers.agg(F.max("part")).first()[0]
    left = (left or 0) + (parts is None)
    def merged(rows: list) -> Iterator[tuple[int, int, np.ndarray]]:
        s = Sketch(size)
        # heaviest first, then by value: the result depends on the buffers only, not on their order
        for w, e, v in sorted(rows, key=lambda r: (-r[0], r[1], len(r[2]), r[2][0], r[2][-1])):
            if w > 1:
                s.full.setdefault(w, []).append((v, e))
            else:
                s.loose.append(v)
        s._pack()
        for w in sorted(s.full):
            s._collapse(w)
        return s.rows()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, *r) for i, rows in enumerate(_buffers(b.column("b"))) for r in merged(rows)]
            if out:
                at = pa.array([r[0] for r in out])
                kept = [b.column(c).take(at) for c in [*keys, "part"]]
                arrays = [*kept, pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, [*keys, "part", "weight", "error", "vals"])

    schema = ", ".join(f"`{k}` {buffers.schema[k].dataType.simpleString()}" for k in keys) + ", part int, " + _SCHEMA
    while left > 1:
        grouped = buffers.withColumn("part", F.floor(F.col("part") / fan_in).cast("int"))
        buffers = grouped.groupBy(*keys, "part").agg(_gathered()).mapInArrow(run, schema)
        left = -(-left // fan_in)
    return buffers


def percentiles(buffers: DataFrame, keys: list[str], qs: list[float], eps: float = 0.005) -> DataFrame:
    """(*keys, n, q, value, rank_error, eps): value is within rank_error positions of rank ceil(q * n), and
    rank_error <= eps * n, the stated error (plus one position). buffers must be merged, one part per group."""
    size = buffer_size(eps)
    schema = ", ".join(f"`{k}` {buffers.schema[k].dataType.simpleString()}" for k in keys) + ", n bigint, q double, value double, rank_error bigint, eps double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, value, error = [], [], []
            for rows in _buffers(b.column("b")):
                s = Sketch(size)
                s.loose = [v for w, _, v in rows if w == 1]
                for w, e, v in rows:
                    if w > 1:
                        s.full.setdefault(w, []).append((v, e))
                k, err, vals = s.quantiles(qs)
                n += [k] * len(qs)
                error += [err] * len(qs)
                value += vals
            at = pa.array(np.repeat(np.arange(b.num_rows), len(qs)))
            some = [pa.array(n, pa.int64()), pa.array(qs * b.num_rows, pa.float64()), pa.array(value, pa.float64()), pa.array(error, pa.int64()), pa.array([eps] * len(n), pa.float64())]
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in keys], *some], [*keys, "n", "q", "value", "rank_error", "eps"])

    return buffers.groupBy(*keys).agg(_gathered()).mapInArrow(run, schema)
