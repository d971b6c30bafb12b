"""Percentiles of very large columns from mergeable sketches (problem 3).

Relative-rank compactors: a level keeps up to a few sections of sorted values; when it is
full, the values far from the protected (upper) tail are compacted (every other one moves up
a level with twice the weight), those near the tail stay.  So the rank of a value is known
within a share of its distance in rank from the top.  A second sketch (``lower``) of the negated
values does the same from the bottom, for shares below a half.  Sketches of days, matches or partitions
merge level by level and keep that error.

A sketch is a set of rows ``sketch, lower, level, state, items, n, least, most`` (``sketch`` names
it), so partial results can be stored and combined later with ``merge_sketches``.  As long as a
group fits the first level nothing is compacted, and its percentiles are exact.

Defined results: null and NaN do not count, infinite values do; a group without values has a row with n = 0 and
null percentiles; null groups are groups; repeats of a row count once (``deduplicated``).
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values in a section.  The error shrinks in proportion; up to 6 K values are kept exactly.
K = 256


#: Partial sketches of a group that meet in one task.
PER_MERGE = 256


class RelativeSketch:
    """Rank sketch that is sharper the nearer to the maximum."""

    def __init__(self, k: int = K, seed: int = 1):
        self.k, self.n = k, 0
        self.levels: list[np.ndarray] = [np.zeros(0)]
        self.states: list[int] = [0]
        self.least, self.most = np.inf, -np.inf
        self.rng = np.random.default_rng(seed)

    def capacity(self, level: int) -> int:
        """Room of a level: sections grow with the logarithm of what it has seen."""
        sections = max(3, int(np.ceil(np.log2(max(2.0, self.n / (self.k * 2.0 ** level))))) + 1)
        return 2 * self.k * sections

    def error(self) -> float:
        """Relative rank error that nearly all queries keep: share of the rank counted from the top (the tests measure about a quarter of it)."""
        return 1.0 / self.k

    def update(self, values: np.ndarray) -> None:
        """Add values; null and NaN are left out."""
        values = np.asarray(values, dtype=np.float64)
        values = values[~np.isnan(values)]
        for start in range(0, len(values), 65_536):
            part = values[start:start + 65_536]
            self.n += len(part)
            self.least, self.most = min(self.least, part.min()), max(self.most, part.max())
            self.levels[0] = np.concatenate([self.levels[0], part])
            self._compress()

    def _compress(self) -> None:
        level = 0
        while level < len(self.levels):
            while len(self.levels[level]) > self.capacity(level):
                self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        values = np.sort(self.levels[level])
        room = self.capacity(level)
        ones = 0
        while self.states[level] >> ones & 1:
            ones += 1
        keep = max(room // 2, room - (ones + 1) * self.k)
        many = max(2, len(values) - keep)
        many -= many % 2
        self.states[level] += 1
        if level + 1 == len(self.levels):
            self.levels.append(np.zeros(0))
            self.states.append(0)
        self.levels[level + 1] = np.concatenate([self.levels[level + 1], values[int(self.rng.integers(2)):many:2]])
        self.levels[level] = values[many:]

    def merge(self, level: int, state: int, items: np.ndarray) -> None:
        """Take a level of another sketch; counts and bounds come through :meth:`take`."""
        while len(self.levels) <= level:
            self.levels.append(np.zeros(0))
            self.states.append(0)
        self.levels[level] = np.concatenate([self.levels[level], items])
        self.states[level] |= state

    def take(self, n: int, least: float | None, most: float | None) -> None:
        """Count in another sketch's values, once a sketch."""
        self.n += n
        if n:
            self.least, self.most = min(self.least, least), max(self.most, most)

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        """Values in order and the rank from below up to each."""
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(v), 2 ** h) for h, v in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weights[order])

    def quantiles(self, shares: list[float]) -> list[float | None]:
        """Smallest kept value whose rank reaches each share (nearest rank)."""
        if not self.n:
            return [None] * len(shares)
        values, ranks = self.weighted()
        out = []
        for q in shares:
            target = max(1.0, np.ceil(q * ranks[-1] - 1e-9))
            out.append(float(self.least) if q <= 0 else float(self.most) if q >= 1 else float(values[min(np.searchsorted(ranks, target), len(values) - 1)]))
        return out

    def from_top(self, places: list[int]) -> list[float | None]:
        """Kept value at each rank counted from the top (1 is the greatest)."""
        if not self.n:
            return [None] * len(places)
        values, ranks = self.weighted()
        return [float(values[np.searchsorted(ranks, ranks[-1] - min(max(k, 1), ranks[-1]) + 1)]) for k in places]

    def rows(self) -> list[tuple]:
        """``sketch, level, state, items, n, least, most``; n is told once, at level 0."""
        known, name = self.n > 0, random.getrandbits(62)
        return [(name, h, self.states[h], v, self.n if h == 0 else 0, float(self.least) if known else None, float(self.most) if known else None)
                for h, v in enumerate(self.levels)]


_SKETCH = "sketch bigint, level int, state bigint, items array<double>, n bigint, least double, most double"
_FIELDS = [("sketch", pa.int64()), ("level", pa.int32()), ("state", pa.int64()), ("items", pa.list_(pa.float64())), ("n", pa.int64()), ("least", pa.float64()), ("most", pa.float64())]


def _table(keys: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    fields = [*keys, *_FIELDS]
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.Table.from_arrays([pa.array([*c], type=t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def deduplicated(rows: DataFrame, columns: list[str], when: str) -> DataFrame:
    """Rows that agree in ``columns`` as one, with the earliest ``when``."""
    return rows.groupBy(*columns).agg(F.min(when).alias(when))


def build_sketches(rows: DataFrame, by: list[str], value: str, k: int = K) -> DataFrame:
    """``by..., sketch rows``: partial sketches of every task's rows, upper and lower (no shuffle; merge them next).

    Every group seen gets a sketch, also one that holds only nulls.
    """
    slim = rows.select(*by, F.col(value).cast("double").alias("_value"))
    ddl = ", ".join(f"`{c}` {t}" for c, t in slim.dtypes if c != "_value")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, RelativeSketch] = {}
        types: list = []
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(by))]
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_pylist() for i in range(len(by))]
            codes: dict[tuple, int] = {}
            code = np.fromiter((codes.setdefault(k_, len(codes)) for k_ in zip(*keys)), dtype=np.int64, count=batch.num_rows) if by else np.zeros(batch.num_rows, dtype=np.int64)
            if not by:
                codes[()] = 0
            values = np.asarray(batch.column(len(by)).to_pandas(), dtype=np.float64)
            order = np.argsort(code, kind="stable")
            cuts = np.searchsorted(code[order], np.arange(len(codes) + 1))
            for group, c in codes.items():
                mine = values[order[cuts[c]:cuts[c + 1]]]
                for lower in (False, True):
                    kept.setdefault((*group, lower), RelativeSketch(k)).update(-mine if lower else mine)
            if len(kept) > 20_000:
                yield from _table([*zip(by, types), ("lower", pa.bool_())], [(*g, *r) for g, s in kept.items() for r in s.rows()]).to_batches()
                kept.clear()
        if kept:
            yield from _table([*zip(by, types), ("lower", pa.bool_())], [(*g, *r) for g, s in kept.items() for r in s.rows()]).to_batches()

    return slim.mapInArrow(build, f"{ddl}, lower boolean, {_SKETCH}" if by else f"lower boolean, {_SKETCH}")


def merge_sketches(sketches: DataFrame, by: list[str], k: int = K, salts: int | None = None) -> DataFrame:
    """One sketch per group of ``by`` from any number of partial ones.

    With ``salts`` above 1 a first round merges within so many random parts of each group, so
    that a group with very many partial sketches does not meet in one task at once.  A sketch
    stays whole in its part (its levels are only told from one another by ``n``).  A group has at
    most one partial sketch a task, so the salts follow from the session's shuffle partitions:
    one for every ``PER_MERGE`` of them.
    """
    if salts is None:
        salts = max(1, -(-int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions")) // PER_MERGE))
    by = [*by, "lower"]
    kinds = {f.name: f.dataType for f in sketches.schema.fields}
    ddl = "".join(f"`{c}` {kinds[c].simpleString()}, " for c in by)

    def merge(key: tuple, part: pa.Table) -> pa.Table:
        if part.num_rows == 1:  # nothing to merge
            return part.select([*by, *(c for c, _ in _FIELDS)])
        whole = RelativeSketch(k)
        levels: dict[int, list[np.ndarray]] = {}
        states: dict[int, int] = {}
        lists = part["items"].combine_chunks()
        offsets, flat = np.asarray(lists.offsets), np.asarray(lists.values.to_numpy(zero_copy_only=False), dtype=np.float64)
        n, least, most = (part[c].to_pylist() for c in ("n", "least", "most"))
        for i, (level, state) in enumerate(zip(part["level"].to_pylist(), part["state"].to_pylist())):
            levels.setdefault(level, []).append(flat[offsets[i]:offsets[i + 1]])
            states[level] = states.get(level, 0) | state
            whole.take(n[i], least[i], most[i])
        for level in sorted(levels):
            whole.merge(level, states[level], np.concatenate(levels[level]))
        whole._compress()
        table = _table([], whole.rows())
        for i, c in reversed([*enumerate(by)]):
            table = table.add_column(0, pa.field(c, part.schema.field(c).type), pa.array([part[c][0].as_py()] * table.num_rows, type=part.schema.field(c).type))
        return table

    slim = sketches.select(*by, "sketch", "level", "state", "items", "n", "least", "most")
    if salts > 1:
        salted = slim.withColumn("_salt", F.pmod(F.xxhash64("sketch"), F.lit(salts)))
        slim = salted.groupBy(*by, "_salt").applyInArrow(merge, ddl + _SKETCH)
    return slim.groupBy(*by).applyInArrow(merge, ddl + _SKETCH)


def percentiles_of(sketches: DataFrame, by: list[str], shares: list[float], k: int = K) -> DataFrame:
    """``by..., n, share, value, rank_error``: percentiles from merged sketches.

    ``rank_error`` is the stated bound in ranks: a share of the rank counted from the nearer end.
    """
    kinds = {f.name: f.dataType for f in sketches.schema.fields}
    ddl = "".join(f"`{c}` {kinds[c].simpleString()}, " for c in by)

    def read(key: tuple, part: pa.Table) -> pa.Table:
        sides = RelativeSketch(k), RelativeSketch(k)
        for lower, _, level, state, items, n, least, most in zip(*(part[c].to_pylist() for c in ("lower", *(c for c, _ in _FIELDS)))):
            sides[lower].merge(level, state, np.array(items, dtype=np.float64))
            sides[lower].take(n, least, most)
        upper, under = sides
        low = under.from_top([int(np.ceil(q * under.n - 1e-9)) for q in shares])
        values = [-v if 0 < q < 0.5 and v is not None else u for q, u, v in zip(shares, upper.quantiles(shares), low)]
        bounds = [0.0 if len(sides[q < 0.5].levels) == 1 else upper.error() * upper.n * min(q, 1 - q) + 1 for q in shares]
        table = pa.table({"n": pa.array([upper.n] * len(shares), type=pa.int64()), "share": shares, "value": pa.array(values, type=pa.float64()),
                          "rank_error": pa.array(bounds, type=pa.float64())})
        for i, c in reversed([*enumerate(by)]):
            table = table.add_column(0, pa.field(c, part.schema.field(c).type), pa.array([part[c][0].as_py()] * table.num_rows, type=part.schema.field(c).type))
        return table

    return sketches.groupBy(*by).applyInArrow(read, ddl + "n bigint, share double, value double, rank_error double")


def rank_check(rows: DataFrame, estimates: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by..., share, within``: does each estimate's true rank keep the stated error?

    One pass over the rows with a handful of estimates per group beside them; no sort.
    """
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in by]
    on = same[0]
    for c in same[1:]:
        on = on & c
    usable = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, value).agg(F.count("*").alias("_c"))
    joined = estimates.alias("e").join(usable.alias("r"), on, "left")
    v = F.col(f"r.{value}")
    ranks = (joined.groupBy(*[F.col(f"e.{c}") for c in by], "e.share", "e.n", "e.value", "e.rank_error")
             .agg(F.sum(F.when(v < F.col("e.value"), F.col("r._c")).otherwise(0)).alias("_below"), F.sum(F.when(v <= F.col("e.value"), F.col("r._c")).otherwise(0)).alias("_upto")))
    target = F.greatest(F.lit(1.0), F.ceil(F.col("share") * F.col("n")))
    off = F.greatest(F.lit(0.0), F.col("_below") + 1 - target, target - F.col("_upto"))
    return ranks.select(*by, "share", ((F.col("n") == 0) | (off <= F.col("rank_error"))).alias("within"))
