"""Ranks and running sums over a total order, in two passes over range partitions.

The rows are range-partitioned by group and order, sorted, and kept in a checkpoint, so that the second pass meets the same
rows in the same places. The first pass sends a row for each partition: its first and its last group and what the last
group sums to there. From these the driver works out what each partition starts with, and the second pass adds that. A
group may span any number of partitions, and none is ever gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.llm.common import checkpointed

#: An odd number whose powers weigh the members of a chain, modulo 2^64.
BASE = 0x9E3779B97F4A7C15
_FULL = (1 << 64) - 1


class Totals:
    """How many rows a group has so far, and its sums and chains, modulo 2^64."""

    def __init__(self, n: int = 0, sums: tuple[int, ...] = (), chains: tuple[int, ...] = ()):
        self.n, self.sums, self.chains = n, tuple(s & _FULL for s in sums), tuple(c & _FULL for c in chains)

    def then(self, other: Totals) -> Totals:
        weight = pow(BASE, self.n, 1 << 64)
        return Totals(self.n + other.n, tuple(a + b for a, b in zip(self.sums, other.sums)), tuple(a + weight * b for a, b in zip(self.chains, other.chains)))

    @staticmethod
    def zero(sums: int, chains: int) -> Totals:
        return Totals(0, (0,) * sums, (0,) * chains)


class Pass:
    """Goes through the batches of a partition in order, group by group."""

    def __init__(self, sums: int, chains: int, start: Totals):
        self.sums, self.chains, self.now = sums, chains, start
        self.first = self.last = None
        self.whole, self.seen = True, False
        self._powers = np.ones(1, np.uint64)

    def powers(self, n: int) -> np.ndarray:
        if len(self._powers) < n:
            self._powers = np.full(2 * n, np.uint64(BASE))
            self._powers[0] = 1
            np.multiply.accumulate(self._powers, out=self._powers)
        return self._powers[:n]

    def step(self, group: pa.Array, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Places in their group of a batch's rows; running sums, then chains, up to and with each row, and chains before it."""
        n = len(group)
        change = pc.not_equal(group[1:], group[:-1]).to_numpy(zero_copy_only=False).astype(bool)
        if not self.seen:
            self.first, self.seen = group[0].as_py(), True
        elif group[0].as_py() != self.last:
            self.now, self.whole = Totals.zero(self.sums, self.chains), False
        self.whole &= not change.any()
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        begin = np.repeat(starts, np.diff(np.concatenate([starts, [n]])))
        local = np.arange(n) - begin
        carried = begin == 0
        place = local + np.where(carried, self.now.n, 0)
        outs, befores = [], []
        weight = pow(BASE, self.now.n, 1 << 64)
        for k, values in enumerate(columns):
            chain = k >= self.sums
            values = values.view(np.uint64) * self.powers(n)[local] if chain else values.view(np.uint64)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(values, out=total[1:])
            run = total[1:] - total[begin]
            before = self.now.chains[k - self.sums] if chain else self.now.sums[k]
            outs.append(np.where(carried, run * np.uint64(weight if chain else 1) + np.uint64(before), run))
            if chain:
                befores.append(outs[-1] - values * np.where(carried, np.uint64(weight), np.uint64(1)))
        self.last = group[n - 1].as_py()
        ends = [int(o[-1]) for o in outs]
        self.now = Totals(int(place[-1]) + 1, tuple(ends[: self.sums]), tuple(ends[self.sums :]))
        return place, [o.view(np.int64) for o in (*outs, *befores)]


def running(df: DataFrame, group: str, by: list[str], sums: tuple[str, ...] = (), chains: tuple[str, ...] = ()) -> DataFrame:
    """df with `place`, the number of rows of its group before a row, for each c of sums and chains `c_run`, and for chains `c_before`.

    Both run up to and with a row, modulo 2^64, or end before it; a chain weighs a row's value by a power of its place, so that chains tell
    sequences apart. group: a column of texts or whole numbers without nulls; the order is by group, then by `by`, nulls
    first, and among rows equal in all of these any. The values are longs without nulls. No rows give no rows.
    """
    spark = df.sparkSession
    names = [*sums, *chains]
    laid = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (group, *by)]).sortWithinPartitions(group, *by)
    laid = checkpointed(laid.withColumn("_part", F.spark_partition_id()))
    s, c = len(sums), len(chains)
    texts = df.schema[group].dataType.simpleString() == "string"

    def columns(part: pa.RecordBatch) -> list[np.ndarray]:
        return [part.column(part.schema.get_field_index(x)).to_numpy(zero_copy_only=False).astype(np.int64) for x in names]

    def last_group(parts):
        it, at = Pass(s, c, Totals.zero(s, c)), None
        for part in parts:
            if part.num_rows:
                it.step(part.column(part.schema.get_field_index(group)), columns(part))
                at = part.column(part.schema.get_field_index("_part"))[0].as_py()
        if at is not None:
            key = pa.string() if texts else pa.int64()
            row = [[at], [it.first], [it.last], [it.whole], [it.now.n], [[str(x) for x in (*it.now.sums, *it.now.chains)]]]
            types = [pa.int32(), key, key, pa.bool_(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=["part", "first", "last", "whole", "n", "totals"])

    key = "string" if texts else "long"
    ends = laid.select(group, *[x for x in names if x != group], "_part").mapInArrow(last_group, f"part int, first {key}, last {key}, whole boolean, n long, totals array<string>")
    starts, now, last = {}, None, None
    for row in sorted(ends.collect(), key=lambda r: r["part"]):  # a row for each partition
        totals = [int(x) for x in row["totals"]]
        own, before = Totals(row["n"], tuple(totals[:s]), tuple(totals[s:])), now if now is not None and row["first"] == last else Totals.zero(s, c)
        starts[row["part"]] = before
        now, last = before.then(own) if row["whole"] else own, row["last"]
    shared = spark.sparkContext.broadcast({p: (t.n, t.sums, t.chains) for p, t in starts.items()})
    kept, added = list(df.columns), [*[f"{x}_run" for x in names], *[f"{x}_before" for x in chains]]

    def summed(parts):
        it = None
        for part in parts:
            if part.num_rows:
                it = it or Pass(s, c, Totals(*shared.value[part.column(part.schema.get_field_index("_part"))[0].as_py()]))
                place, outs = it.step(part.column(part.schema.get_field_index(group)), columns(part))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(kept))], pa.array(place, pa.int64()), *[pa.array(o, pa.int64()) for o in outs]], names=[*kept, "place", *added])

    schema = StructType([*df.schema.fields, StructField("place", LongType()), *[StructField(x, LongType()) for x in added]])
    return laid.mapInArrow(summed, schema)
