"""What the state of a stream holds of each kind of synopsis: add() takes a block of elements, merge() another part's, answer() gives (key, estimation)."""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa

from tidemark.functions.arrays import projection
from tidemark.functions.hashing import PRIME, text_number
from tidemark.operators import clustering, frequency
from tidemark.operators.summaries import RankSummary, WindowRanks, WindowSample, priority


class Block:
    """Elements in the order of their time."""

    def __init__(self, streams: list, fields: list[dict], at: list[int]):
        self.streams, self.fields, self.at, self._columns, self._table = streams, fields, at, {}, None

    @classmethod
    def of(cls, table: pa.Table) -> Block:
        """Elements as columns: at, stream, and `field x` for each field x."""
        block = cls(table.column("stream").to_pylist(), [], table.column("at").to_pylist())
        block._table = table
        return block

    def column(self, name: str | None) -> list:
        """A field as text, None where it is missing; streamID is the element's stream."""
        if name not in self._columns:
            if name == "streamID":
                self._columns[name] = self.streams
            elif self._table is None:
                self._columns[name] = [f.get(name) for f in self.fields]
            else:
                there = f"field {name}" in self._table.column_names
                self._columns[name] = self._table.column(f"field {name}").to_pylist() if there else [None] * len(self.at)
        return self._columns[name]

    def numbers(self, name: str) -> np.ndarray:
        """A field as numbers, NaN where it is none."""
        out = np.full(len(self.at), np.nan)
        for k, v in enumerate(self.column(name)):
            try:
                out[k] = float(v)
            except (TypeError, ValueError):
                pass
        return out


class Live:
    """A synopsis of a key field and a value field with its parameters."""

    def __init__(self, key: str, value: str | None, params: dict):
        self.key, self.value, self.params = key, value, params

    def weights(self, block: Block) -> dict[str, int]:
        """The summed weights of the block's keys: ones, or whole values."""
        weights = np.ones(len(block.at)) if self.value is None else np.nan_to_num(np.trunc(block.numbers(self.value)))
        total: dict[str, int] = {}
        for k, w in zip(block.column(self.key), weights.tolist()):
            if k is not None:
                total[k] = total.get(k, 0) + int(w)
        return total


def numbers_of(keys) -> np.ndarray:
    return np.array([text_number(k) for k in keys], np.int64)


def places(x: np.ndarray, hashes, width: int) -> np.ndarray:
    """A row for each hash function."""
    return np.array([(a * x + b) % PRIME % width for a, b in hashes], np.int64).reshape(len(hashes), len(x))


class CountMin(Live):
    def __init__(self, key, value, params):
        super().__init__(key, value, params)
        spec = frequency.CountMin(params["eps"], params["confidence"], params["seed"], text=True)
        self.hashes, self.width = spec.hashes, spec.width
        self.cells = np.zeros((len(self.hashes), self.width), np.int64)

    def add(self, block):
        total = self.weights(block)
        for row, at in enumerate(places(numbers_of(total), self.hashes, self.width)):
            np.add.at(self.cells[row], at, np.array(list(total.values()), np.int64))

    def merge(self, other):
        self.cells += other.cells

    def answer(self, asked):
        at = places(numbers_of(asked), self.hashes, self.width)
        return [(k, str(int(v))) for k, v in zip(asked, np.take_along_axis(self.cells, at, 1).min(0))] if asked else []

    def running(self, block):
        """An answer for each element, at its time."""
        if self.value is None:
            weights = np.ones(len(block.at), np.int64)
        else:
            weights = np.nan_to_num(np.trunc(block.numbers(self.value))).astype(np.int64)
        some = [(i, k) for i, k in enumerate(block.column(self.key)) if k is not None]
        at = places(numbers_of([k for _, k in some]), self.hashes, self.width)
        after = np.empty(at.shape, np.int64)
        for row, own in enumerate(at):  # running sums of each counter: sorted by counter, in order of time
            order = np.argsort(own, kind="stable")
            w = weights[[i for i, _ in some]][order] if len(order) else np.zeros(0, np.int64)
            total, first = np.cumsum(w), np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]])) if len(order) else np.zeros(0, np.int64)
            base = np.repeat(total[first] - w[first], np.diff(np.append(first, len(order))))
            after[row, order] = total - base + self.cells[row, own[order]]
        return [(k, str(int(v)), block.at[i]) for (i, k), v in zip(some, after.min(0))] if some else []


class Bloom(Live):
    def __init__(self, key, value, params):
        super().__init__(key, value, params)
        spec = frequency.Bloom(params["elements"], params["fpp"], text=True)
        self.hashes, self.cells = spec.hashes, np.zeros(spec.bits, bool)

    def add(self, block):
        self.cells[places(numbers_of({k for k in block.column(self.key) if k is not None}), self.hashes, len(self.cells)).ravel()] = True

    def merge(self, other):
        self.cells |= other.cells

    def answer(self, asked):
        return [(k, str(bool(v)).lower()) for k, v in zip(asked, self.cells[places(numbers_of(asked), self.hashes, len(self.cells))].all(0))] if asked else []


class Ams(Live):
    """Keys are asked for; without any the second moment is."""

    def __init__(self, key, value, params):
        super().__init__(key, value, params)
        spec = frequency.AMS(params["depth"], params["width"], params.get("seed", 2), text=True)
        self.buckets, self.signs = zip(*spec.hashes)
        self.cells = np.zeros((spec.depth, spec.width), np.int64)

    def _signed(self, keys):
        x = numbers_of(keys)
        return places(x, self.buckets, self.cells.shape[1]), places(x, self.signs, 2) * 2 - 1

    def add(self, block):
        total = self.weights(block)
        at, sign = self._signed(total)
        for row in range(len(at)):
            np.add.at(self.cells[row], at[row], sign[row] * np.array(list(total.values()), np.int64))

    def merge(self, other):
        self.cells += other.cells

    def answer(self, asked):
        if not asked:
            return [("second moment", str(int(np.median((self.cells * self.cells).sum(1)))))]
        at, sign = self._signed(asked)
        return [(k, str(int(v))) for k, v in zip(asked, np.median(sign * np.take_along_axis(self.cells, at, 1), axis=0))]


class Distinct(Live):
    """HyperLogLog with 2**12 registers."""

    LOG = 12

    def __init__(self, key, value, params):
        super().__init__(key, value, params)
        self.cells = np.zeros(1 << self.LOG, np.uint8)

    def add(self, block):
        for k in {k for k in block.column(self.value or self.key) if k is not None}:
            h = priority(k)
            rest = h & (1 << 64 - self.LOG) - 1
            self.cells[h >> 64 - self.LOG] = max(self.cells[h >> 64 - self.LOG], 64 - self.LOG - rest.bit_length() + 1)

    def merge(self, other):
        self.cells = np.maximum(self.cells, other.cells)

    def answer(self, asked):
        m = len(self.cells)
        n, empty = 0.7213 / (1 + 1.079 / m) * m * m / np.exp2(-self.cells.astype(float)).sum(), int((self.cells == 0).sum())
        return [(self.value or self.key, str(round(m * math.log(m / empty) if n <= 2.5 * m and empty else n)))]


class Lossy(Live):
    """Counts that miss at most eps * n: keys seen seldom are forgotten at the end of each 1 / eps elements."""

    def __init__(self, key, value, params):
        super().__init__(key, value, params)
        self.n, self.counts = 0, {}

    def add(self, block):
        wide = math.ceil(1 / self.params["eps"])
        for k in block.column(self.key):
            if k is None:
                continue
            self.n += 1
            f, missed = self.counts.get(k, (0, (self.n - 1) // wide))
            self.counts[k] = (f + 1, missed)
            if self.n % wide == 0:
                self.counts = {x: c for x, c in self.counts.items() if sum(c) > self.n // wide}

    def merge(self, other):
        for k, (f, missed) in other.counts.items():
            own = self.counts.get(k, (0, 0))
            self.counts[k] = (own[0] + f, own[1] + missed)
        self.n += other.n

    def answer(self, asked):
        return [(k, str(self.counts.get(k, (0, 0))[0])) for k in asked]


class Sticky(Live):
    """Sampled keys are counted from then on; the rate halves as the stream doubles, and counts are thinned out by coins."""

    def __init__(self, key, value, params):
        super().__init__(key, value, params)
        p = params
        self.span = math.ceil(math.log(1 / (p["support"] * p["failure"])) / p["eps"])
        self.n, self.rate, self.counts, self.rng = 0, 1, {}, np.random.default_rng(11)

    def add(self, block):
        for k in block.column(self.key):
            if k is None:
                continue
            self.n += 1
            while self.n > 2 * self.span * self.rate:
                self.rate *= 2
                self.counts = {x: f for x, c in self.counts.items() if (f := c - int(self.rng.geometric(0.5)) + 1) > 0}
            if k in self.counts or self.rng.random() * self.rate < 1:
                self.counts[k] = self.counts.get(k, 0) + 1

    merge = None

    def answer(self, asked):
        return [(k, str(self.counts.get(k, 0))) for k in asked]


def merged_counts(self, other):
    for k, f in other.counts.items():
        self.counts[k] = self.counts.get(k, 0) + f
    self.n += other.n


Sticky.merge = merged_counts


class Quantiles(Live):
    def __init__(self, key, value, params):
        super().__init__(key, value, params)
        self.ranks = RankSummary(params["eps"])

    def add(self, block):
        x = block.numbers(self.value or self.key)
        self.ranks.add(x[~np.isnan(x)])

    def merge(self, other):
        self.ranks.merge(other.ranks)

    def answer(self, asked):
        return [(q, str(v)) for q in asked if (v := self.ranks.quantile(float(q))) is not None]


class PerKey(Live):
    """Something for each key. A key's elements come to one part; at random ones each part answers for itself."""

    def __init__(self, key, value, params):
        super().__init__(key, value, params)
        self.of: dict[str, object] = {}

    def groups(self, block):
        rows: dict[str, list[int]] = {}
        for i, k in enumerate(block.column(self.key)):
            if k is not None:
                rows.setdefault(k, []).append(i)
        return rows.items()

    def merge(self, other):
        self.of |= other.of


class WindowQuantiles(PerKey):
    def add(self, block):
        x = block.numbers(self.value)
        for k, rows in self.groups(block):
            own = x[rows]
            self.of.setdefault(k, WindowRanks(self.params["eps"], self.params["window"])).add(own[~np.isnan(own)])

    def answer(self, asked):
        return [(f"{k}_{q}", str(v)) for k, w in self.of.items() for q in asked if (v := w.quantile(float(q))) is not None]


class Lsh(PerKey):
    """The last `window` values of each key; the answer is the Hamming weight of their signs under random projections."""

    def add(self, block):
        x = block.numbers(self.value)
        for k, rows in self.groups(block):
            own = x[rows]
            self.of[k] = np.concatenate([self.of.get(k, np.zeros(0)), own[~np.isnan(own)]])[-self.params["window"] :]

    def answer(self, asked):
        if asked:
            raise ValueError("pairs come out of lsh_as_it_arises")
        n, out = self.params["window"], []
        matrix = np.array(projection(self.params["bits"], n, 35))
        for k, x in self.of.items():
            if len(x) == n and x.min() < x.max():
                out.append((k, str(int((matrix @ (x - x.mean()) > 0).sum()))))
        return out


class Sample(Live):
    """Of all elements, by the priorities of their keys."""

    def __init__(self, key, value, params):
        super().__init__(key, value, params)
        self.rows = WindowSample(params["size"])

    def add(self, block):
        self.rows.add([(0, priority(k), (k, v)) for k, v in zip(block.column(self.key), block.column(self.value or self.key)) if k is not None])

    def merge(self, other):
        self.rows.merge(other.rows)

    def answer(self, asked):
        return [x[2] for x in self.rows.sample()]

    def running(self, block):
        """One element in two, by a coin of its key."""
        return [(k, v, at) for k, v, at in zip(block.column(self.key), block.column(self.value or self.key), block.at) if k is not None and priority(k) % 2 == 0]


class WindowedSample(Sample):
    """Of the elements of the last `window` units of time."""

    def __init__(self, key, value, params):
        super().__init__(key, value, params)
        self.rows = WindowSample(params["size"], params["window"])

    def add(self, block):
        columns = zip(block.column(self.key), block.column(self.value or self.key), block.at)
        self.rows.add([(at, priority(k, v, at), (k, v)) for k, v, at in columns if k is not None])


class TopK(Live):
    """At each time the k + 1 lowest; asked for are a number and a time, however long ago. A series has one value at a time."""

    def __init__(self, key, value, params):
        super().__init__(key, value, params)
        self.lowest: dict[str, dict[str, float]] = {}

    def _trim(self, times):
        for t in times:
            if len(rows := self.lowest[t]) > self.params["k"] + 1:
                self.lowest[t] = dict(sorted(rows.items(), key=lambda r: (r[1], r[0]))[: self.params["k"] + 1])

    def add(self, block):
        x, times = block.numbers(self.value), set()
        for k, t, v in zip(block.column(self.key), block.column(self.params["time"]), x.tolist()):
            if k is not None and t is not None and not math.isnan(v):
                self.lowest.setdefault(t, {})[k] = v
                times.add(t)
        self._trim(times)

    def merge(self, other):
        for t, rows in other.lowest.items():
            self.lowest.setdefault(t, {}).update(rows)
        self._trim(other.lowest)

    def answer(self, asked):
        k, rows = int(asked[0]), sorted((v, s) for s, v in self.lowest.get(asked[1], {}).items())
        bar = rows[k][0] if len(rows) > k else math.inf
        return [(s, str(v)) for v, s in rows if v < bar]


class Coreset(PerKey):
    """Points of `dims` consecutive values of a key in buckets that are merged and reduced; asked for is the number of clusters."""

    def __init__(self, key, value, params):
        super().__init__(key, value, params)
        self.points = clustering.Buckets(params["size"], 1)

    def add(self, block):
        x, dims, points = block.numbers(self.value), self.params["dims"], []
        for k, rows in self.groups(block):
            values = np.concatenate([self.of.get(k, np.zeros(0)), x[rows][~np.isnan(x[rows])]])
            whole = len(values) // dims * dims
            points.append(values[:whole].reshape(-1, dims))
            self.of[k] = values[whole:]
        if points:
            p = np.concatenate(points)
            self.points.add(p, np.ones(len(p)))

    def merge(self, other):
        self.points.merge(other.points)

    def answer(self, asked):
        few = self.points.coreset()
        if few is None:
            return []
        _, centres, weights = clustering.lloyd(*few, int(asked[0]), 5, 50, 1)
        return [(str(k), " ".join([str(float(round(w))), *(str(round(float(v), 6)) for v in c)])) for k, (c, w) in enumerate(zip(centres, weights))]


class Segments(PerKey):
    """Counts of values that end in 1 before each value that ends in 2: of each key the open segment's, and those of all its segments, in their order."""

    def add(self, block):
        for k, v in zip(block.column(self.key), block.column(self.value)):
            if k is None or v is None:
                continue
            now, counts = self.of.get(k) or (0, array("q"))
            if v.endswith("2"):
                counts.append(now)
            self.of[k] = (0 if v.endswith("2") else now + v.endswith("1"), counts)

    def answer(self, asked):
        return ((f"{k}|{n}", str(c)) for k, (_, counts) in self.of.items() for n, c in enumerate(counts))


class LastCounts(Segments):
    """The counts of each key's last `length` segments."""

    def add(self, block):
        super().add(block)
        for _, counts in self.of.values():
            del counts[: max(0, len(counts) - self.params["length"])]

    def answer(self, asked):
        return [(k, ",".join(map(str, counts))) for k, (_, counts) in self.of.items() if counts]


#: By the names of plans.spec.SYNOPSIS_IDS.
LIVE: dict[str, type[Live]] = {
    "count_min": CountMin, "bloom": Bloom, "ams": Ams, "coreset": Coreset, "hyperloglog": Distinct, "sticky": Sticky, "lossy": Lossy, "chain_sample": WindowedSample,
    "quantiles": Quantiles, "topk": TopK, "lsh": Lsh, "wor_sample": Sample, "window_quantiles": WindowQuantiles, "finjoin": Segments, "counters": LastCounts,
}
