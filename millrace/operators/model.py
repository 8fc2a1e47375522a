"""Models as plugins: a model is loaded once a Python worker and takes batches of equal sequences.

A model is whatever load() returns. Its method takes ids (rows x length) and gives arrays with a row a sequence. What
load() needs (a path, a table of bounded size) travels with it; the rows stay where they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Models of this worker, by plan.
_LOADED: dict[str, object] = {}


def _model(key: str, load: Callable[[], object]) -> object:
    if key not in _LOADED:
        _LOADED.clear()  # a worker that goes on to another plan gives the last one's model back
        _LOADED[key] = load()
    return _LOADED[key]


def apply(rows: DataFrame, keys: list[str], load: Callable[[], object], method: str, schema: str, batch: int = 16) -> DataFrame:
    """rows (keys, ids: array<int>) -> keys and schema: what the model's method gives for batches of at most so many
    sequences of one length. Null and empty sequences are not asked about; they give no row.

    The method takes an int64 array (rows x length) and returns a list of arrays, one a column of schema, each with a
    row a sequence; arrays of two dimensions become arrays of doubles.
    """
    name, out = uuid.uuid4().hex, [x.strip().split(" ")[0] for x in schema.split(",")]
    rows = rows.select(*keys, F.col("ids").cast("array<long>").alias("ids")).filter("size(ids) > 0 and not exists(ids, x -> x is null)")

    def column(x: np.ndarray) -> pa.Array:
        x = np.asarray(x)
        if x.ndim == 1:
            return pa.array(x)
        ends = np.arange(len(x) + 1, dtype=np.int32) * int(np.prod(x.shape[1:]))
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.reshape(-1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(name, load)
        for b in batches:
            ids = b.column("ids")
            size, flat = ids.value_lengths().to_numpy(), ids.flatten().to_numpy()
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            for length in np.unique(size).tolist():
                at = np.flatnonzero(size == length)
                for i in range(0, len(at), batch):
                    some = at[i : i + batch]
                    found = getattr(model, method)(flat[start[some][:, None] + np.arange(length)])
                    own = b.select(keys).take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([*own.columns, *map(column, found)], [*keys, *out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return rows.mapInArrow(run, f"{kinds}, {schema}")


class Bigrams:
    """Costs of ids by the one before: add-one counts over size x size, whatever the corpus."""

    def __init__(self, counts: np.ndarray) -> None:
        self.cost = -np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + counts.shape[1]))

    def losses(self, ids: np.ndarray) -> list[np.ndarray]:
        """The cost of every id after the first of its sequence."""
        return [self.cost[ids[:, :-1], ids[:, 1:]]]


def bigram_counts(rows: DataFrame, size: int) -> np.ndarray:
    """Counts of neighbouring ids below size: size x size numbers at most leave a task and reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size * size, np.int64)
        for b in batches:
            ids = b.column("ids")
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(flat) and not (flat.min() >= 0 and flat.max() < size):
                raise IndexError(f"an id is not below {size}")
            inner = np.ones(len(flat), bool)  # ids that have one behind them
            ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy())
            inner[ends[ends > 0] - 1] = False
            at = np.flatnonzero(inner)
            counts += np.bincount(flat[at] * size + flat[at + 1], minlength=size * size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["pair", "n"])

    found = rows.select("ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size, size)


def window_perplexity(rows: DataFrame, keys: list[str], load: Callable[[], object], end: int, pad: int | None = None, batch: int = 16) -> DataFrame:
    """rows (keys, ids) -> keys, nll_sum, nll_count, ppl: over ids after the first that are neither the end's nor the pad's.

    A window of which no id counts has a sum of 0 and perplexity 1; from e^50 on it is infinite.
    """
    found = apply(rows.select(*keys, "ids"), keys, _with_labels(load, end, pad), "masked", "nll_sum double, nll_count long", batch)
    mean = F.col("nll_sum") / F.greatest(F.col("nll_count"), F.lit(1))
    return found.withColumn("ppl", perplexity(mean))


def perplexity(mean: Column) -> Column:
    return F.when(mean < 50, F.exp(F.least(mean, F.lit(50.0)))).otherwise(float("inf"))


class _Masked:
    def __init__(self, model: object, end: int, pad: int | None) -> None:
        self.model, self.end, self.pad = model, end, pad

    def masked(self, ids: np.ndarray) -> list[np.ndarray]:
        labels = ids[:, 1:]
        counts = (labels != self.end) & (True if self.pad is None else labels != self.pad)
        return [np.where(counts, self.model.losses(ids)[0], 0.0).sum(axis=1), counts.sum(axis=1)]


def _with_labels(load: Callable[[], object], end: int, pad: int | None) -> Callable[[], object]:
    return lambda: _Masked(load(), end, pad)


class Recency:
    """Attention that falls with distance and holds on to equal ids: layers x heads, for queries from first on."""

    def __init__(self, layers: int, heads: int, first: int) -> None:
        self.layers, self.heads, self.first = layers, heads, first

    def attention(self, ids: np.ndarray) -> list[np.ndarray]:
        """layers x heads x queries x keys of each sequence, in one row; the last place asks nothing."""
        n = ids.shape[1]
        q, k = np.arange(self.first, n - 1)[:, None], np.arange(n)[None, :]
        seen = k <= q
        same = ids[:, None, :] == ids[:, self.first : n - 1, None]
        out = np.zeros((len(ids), self.layers, self.heads, len(q), n))
        for layer in range(self.layers):
            for h in range(self.heads):
                w = np.where(seen, 1 / (1 + (q - k) * (h + 1.0)) + (layer + 1.0) * same, 0.0)
                out[:, layer, h] = w / w.sum(axis=2, keepdims=True)
        return [out.reshape(len(ids), -1)]


def attention_rows(rows: DataFrame, keys: list[str], load: Callable[[], object], layers: int, heads: int, first: str, batch: int = 16) -> DataFrame:
    """rows (keys, ids, first: the first query's place, the same for all rows of one length) -> keys, l, h, q, k, a: the
    weights of keys not after their query."""
    found = apply(rows.select(*keys, first, "ids", F.size("ids").alias("_n")), [*keys, first, "_n"], load, "attention", "a array<double>", batch)
    place = found.select(*keys, F.col(first).alias("_first"), "_n", F.posexplode("a").alias("_i", "a"))
    queries = F.col("_n") - 1 - F.col("_first")
    at = lambda by: F.floor(F.col("_i") / by)
    place = place.select(*keys, "a", (at(F.col("_n") * queries * heads)).cast("int").alias("l"), (at(F.col("_n") * queries) % heads).cast("int").alias("h"), (at(F.col("_n")) % queries + F.col("_first")).cast("int").alias("q"), (F.col("_i") % F.col("_n")).cast("int").alias("k"))
    return place.filter("k <= q").select(*keys, "l", "h", "q", "k", "a")
