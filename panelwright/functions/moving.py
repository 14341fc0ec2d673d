"""Moving values over rows that Spark has dealt out by a key and sorted, as Arrow batches in tasks.

A task sees its rows in order, batch by batch, and keeps of what is past as many rows as the longest window needs. So what it holds
depends on the windows, neither on the rows of a key nor on those of a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

State = dict[str, np.ndarray]


def numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """As doubles, NaN for NULL."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.cast(column, pa.float64(), safe=False).to_numpy(zero_copy_only=False)


def doubles(values: np.ndarray) -> pa.Array:
    """As an Arrow column, NULL for NaN."""
    return pa.array(values, pa.float64(), from_pandas=True)


def places(keys: pa.ChunkedArray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """The place of each row among the rows of its key that are here, and whether it is the key's first row of all.

    ``whole`` tells whether the first row here is the first of its key.
    """
    code = keys.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    at = np.arange(len(code))
    starts = np.ones(len(code), bool)
    starts[1:] = code[1:] != code[:-1]
    place = at - np.maximum.accumulate(np.where(starts, at, 0))
    if len(starts):
        starts[0] = whole
    return place, starts


def with_past(batches: Iterator[pa.RecordBatch], key: str, past: int) -> Iterator[tuple[pa.Table, int, np.ndarray, np.ndarray]]:
    """(rows, how many of them are past, place, starts): each batch behind the ``past`` rows before it."""
    kept, whole = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        rows, old = (new, 0) if kept is None else (pa.concat_tables([kept, new]), kept.num_rows)
        place, starts = places(rows[key], whole)
        yield rows, old, place, starts
        first = max(0, rows.num_rows - past)
        kept, whole = rows.slice(first), bool(starts[first]) if first < rows.num_rows else True
        kept = kept.combine_chunks()


def back(values: np.ndarray, k: int) -> np.ndarray:
    """The values k rows before; NaN where there are none."""
    if not k:
        return values
    out = np.empty(values.shape)
    out[:k] = np.nan
    out[k:] = values[:-k]
    return out


def merged(old: State, a: int, new: State, b: int) -> State:
    """The state of ``a`` older and ``b`` newer rows: sums, means, sums of powers about the means, extremes. NaN in either is NaN."""
    n, out = a + b, {}
    if "s" in old:
        out["s"] = old["s"] + new["s"]
    if "m" in old:
        d = new["m"] - old["m"]
        out["m"] = old["m"] + d * (b / n)
    if "m2" in old:
        p, q = old["m2"], new["m2"]
        out["m2"] = p + q + d * d * (a * b / n)
    if "m3" in old:
        out["m3"] = old["m3"] + new["m3"] + d * d * d * (a * b * (a - b) / n**2) + d * (q * a - p * b) * (3 / n)
    if "m4" in old:
        out["m4"] = old["m4"] + new["m4"] + d * d * d * d * (a * b * (a * a - a * b + b * b) / n**3) + d * d * (q * a**2 + p * b**2) * (6 / n**2) + d * (new["m3"] * a - old["m3"] * b) * (4 / n)
    if "c" in old:
        e = new["my"] - old["my"]
        out |= {"my": old["my"] + e * (b / n), "m2y": old["m2y"] + new["m2y"] + e * e * (a * b / n), "c": old["c"] + new["c"] + d * e * (a * b / n)}
    for name, pick in (("hi", np.maximum), ("lo", np.minimum)):
        if name in old:
            out[name] = pick(old[name], new[name])
    return out


def states(one: State, longest: int) -> list[State]:
    """The states of the last 1, 2, 4, ... rows, up to ``longest``."""
    found = [one]
    while 2 << (len(found) - 1) <= longest:
        b = len(found) - 1
        found.append(merged({k: back(v, 1 << b) for k, v in found[b].items()}, 1 << b, found[b], 1 << b))
    return found


def window(found: list[State], n: int, at: np.ndarray | None = None) -> State:
    """The state of the last n rows, put together from those its binary digits name; ``at``: of these rows alone."""
    out, past = {}, 0
    for b in reversed([b for b in range(n.bit_length()) if n >> b & 1]):
        part = {k: back(v, past) if at is None else np.where(at >= past, v[at - past], np.nan) for k, v in found[b].items()}
        out, past = merged(part, 1 << b, out, past) if past else part, past + (1 << b)
    return out


FIELDS = {"sum": ("s",), "mean": ("s",), "std": ("m", "m2"), "skew": ("m", "m2", "m3"), "kurt": ("m", "m2", "m3", "m4"), "max": ("hi",), "min": ("lo",), "corr": ("m", "m2", "my", "m2y", "c"), "cov": ("m", "m2", "my", "m2y", "c")}


def single(x: np.ndarray, y: np.ndarray | None, fields: set[str]) -> State:
    if y is not None:
        missing = np.isnan(x) | np.isnan(y)
        x, y = np.where(missing, np.nan, x), np.where(missing, np.nan, y)
    zero = np.where(np.isnan(x), np.nan, 0.0)
    values = {"s": x, "m": x, "my": y, "hi": x, "lo": x}
    return {f: values.get(f, zero) for f in ("s", "m", "m2", "m3", "m4", "my", "m2y", "c", "hi", "lo") if f in fields}


def result(kind: str, n: int, s: State) -> np.ndarray:
    if kind in ("max", "min"):
        return s["hi" if kind == "max" else "lo"]
    if kind in ("mean", "sum"):
        return s["s"] / n if kind == "mean" else s["s"]
    if kind == "std":
        return np.sqrt(s["m2"] / (n - 1))
    if kind == "cov":
        return s["c"] / (n - 1)
    moving = (s["m2"] > 0) & (s["m2y"] > 0) if kind == "corr" else s["m2"] > 0
    m2 = np.where(moving, s["m2"], np.nan)
    if kind == "corr":
        return s["c"] / np.sqrt(m2) / np.sqrt(s["m2y"])
    if kind == "skew":
        return s["m3"] / (m2 * np.sqrt(m2)) * (n * math.sqrt(n - 1) / (n - 2))
    return ((s["m4"] / (m2 * m2) * n - 3) * (n + 1) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


def covariance(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Sample covariance of the last n rows, updated row by row from the oldest as Spark's ``covar_samp`` is, to the last bit."""
    mx, my, c = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for k in range(n - 1, -1, -1):
        vx, vy = back(x, k), back(y, k)
        dx = vx - mx
        mx = mx + dx / (n - k)
        my = my + (vy - my) / (n - k)
        c = c + dx * (vy - my)
    return c / (n - 1)


def rank(x: np.ndarray, n: int) -> np.ndarray:
    """(average rank of the last value among the last n - 1) / (n - 1)."""
    below = np.where(np.isnan(x), np.nan, 0.0)
    for k in range(1, n):
        old = back(x, k)
        below = below + np.where(np.isnan(old), np.nan, (old < x) + (old == x) / 2)
    return below / (n - 1)


def decay(x: np.ndarray, n: int) -> np.ndarray:
    """Mean weighted 1 .. n, the newest row heaviest."""
    return sum((back(x, n - k) * k for k in range(1, n)), x * n) / (n * (n + 1) / 2)


def reach(alpha: float) -> int:
    """Rows after which an exponential weight is under 1e-17."""
    return math.ceil(math.log(1e17) / -math.log(1 - alpha)) if alpha < 1 else 1


def ewm(x: np.ndarray, alpha: float, adjust: bool, place: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Exponentially weighted mean, as ``ts.with_ewm`` has it: the sums of the last 1, 2, 4, ... rows, each from two of half the length."""
    there = ~np.isnan(x)
    first = there & (starts | ~np.concatenate([[True], there[:-1]]))
    value = np.where(there, x, 0.0)
    parts = [value, there.astype(float)] if adjust else [np.where(first, value, alpha * value)]
    step = 1
    while step < reach(alpha):
        inside = place >= step
        for i, s in enumerate(parts):
            parts[i] = s + np.where(inside, np.nan_to_num(back(s, step)) * (1 - alpha) ** step, 0.0)
        step *= 2
    seen = np.maximum.accumulate(np.where(there, np.arange(len(x)), -1)) >= np.arange(len(x)) - place
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(seen, parts[0] / parts[1] if adjust else parts[0], np.nan)


def rolled(columns: Mapping, source: Callable[[str], np.ndarray], place: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """The values of each of ``columns`` (as for ``ts.with_rolling``), in their order; one may be made of an earlier one."""
    fields: dict[tuple, set[str]] = {}
    longest: dict[tuple, int] = {}
    for r in columns.values():
        if r.kind in FIELDS:
            fields.setdefault((r.x, r.y), set()).update(FIELDS[r.kind])
            longest[r.x, r.y] = max(longest.get((r.x, r.y), 0), r.n)
    made: dict[str, np.ndarray] = {}
    known: dict[tuple, list[State]] = {}
    get = lambda c: made[c] if c in made else source(c)
    with np.errstate(all="ignore"):
        for c, r in columns.items():
            if r.kind == "ewm":
                made[c] = ewm(get(r.x), r.alpha, r.adjust, place, starts)
                continue
            if r.kind == "cov" and r.n <= 32:
                value = covariance(get(r.x), get(r.y), r.n)
            elif r.kind in ("rank", "decay"):
                value = (rank if r.kind == "rank" else decay)(get(r.x), r.n)
            else:
                key = (r.x, r.y)
                if key not in known:
                    known[key] = states(single(get(r.x), get(r.y) if r.y else None, fields[key]), longest[key])
                value = result(r.kind, r.n, window(known[key], r.n))
            made[c] = np.where(place >= r.n - 1, value, np.nan)
    return made


def past_rows(columns: Mapping) -> int:
    """How many rows before its own a value of ``columns`` depends on."""
    depth: dict[str, int] = {}
    for c, r in columns.items():
        depth[c] = (reach(r.alpha) if r.kind == "ewm" else r.n - 1) + max(depth.get(r.x, 0), depth.get(r.y, 0) if r.y else 0)
    return max(depth.values(), default=0)


def rolling(columns: Mapping, key: str):
    """The function for ``mapInArrow`` that adds ``columns`` to rows in order."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, old, place, starts in with_past(batches, key, past_rows(columns)):
            held: dict[str, np.ndarray] = {}
            source = lambda c: held[c] if c in held else held.setdefault(c, numbers(rows[c]))  # noqa: B023, E731
            made = rolled(columns, source, place, starts)
            new = rows.slice(old)
            for c in columns:
                new = new.append_column(c, doubles(made[c][old:]))
            yield from new.combine_chunks().to_batches()

    return add


class Normal:
    """Normalised values of k columns, part by part: forward fill, then 0, z-score over n rows, clipped."""

    def __init__(self, k: int, n: int, limit: float):
        self.n, self.limit, self.filled = n, limit, [np.zeros(0)] * k

    def __call__(self, fresh: Sequence[np.ndarray], place: np.ndarray, wanted: np.ndarray | None = None) -> list[np.ndarray]:
        """Of new rows, the last of those whose ``place`` is given; the rows before them were handed in before. Column by column: what one needs stays in the cache. Where ``wanted`` does not hold, 0."""
        n, new = self.n, len(fresh[0])
        old = min(len(self.filled[0]), n, len(place) - new)
        at = np.arange(old + new)
        begins = at - np.minimum(place[len(place) - len(at) :], at)
        full = place[len(place) - new :] >= n - 1
        asked = old + np.flatnonzero(full if wanted is None else full & wanted)
        made = []
        for i, values in enumerate(fresh):
            x = np.concatenate([self.filled[i][len(self.filled[i]) - old :], np.where(np.isinf(values), np.nan, values)])
            there = ~np.isnan(x)
            if not there.all():
                last = np.maximum.accumulate(np.where(there, at, -1))
                x = np.where(last >= begins, x[np.maximum(last, 0)], 0.0)
            self.filled[i] = x[-n:]
            s = window(states(single(x, None, {"m", "m2"}), n), n, asked)
            z = np.zeros(new)
            with np.errstate(invalid="ignore"):
                z[asked - old] = np.clip((x[asked] - s["m"]) / (np.sqrt(s["m2"] / (n - 1)) + 1e-9), -self.limit, self.limit)
            made.append(z)
        return made


def normal(columns: list[str], key: str, n: int, limit: float):
    """The function for ``mapInArrow`` that puts the normalised values of ``columns`` in their place."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = Normal(len(columns), n, limit)
        for rows, old, place, _ in with_past(batches, key, n):
            new = rows.slice(old)
            for c, z in zip(columns, values([numbers(new[c]) for c in columns], place), strict=True):
                new = new.set_column(new.column_names.index(c), c, pa.array(z))
            yield from new.combine_chunks().to_batches()

    return put


class Arrays:
    """Series of sorted rows by name, and the functions of the factor catalogue on them; NaN for NULL."""

    def __init__(self, rows: pa.Table, place: np.ndarray | None = None, starts: np.ndarray | None = None):
        self.rows, self.place, self.starts, self.made = rows, place, starts, {}

    def __call__(self, name: str) -> np.ndarray:
        if name not in self.made:
            self.made[name] = numbers(self.rows[name])
        return self.made[name]

    def rolled(self, columns: Mapping) -> dict[str, np.ndarray]:
        return rolled(columns, self, self.place, self.starts)

    def weekday(self, name: str) -> np.ndarray:
        """0 on Monday."""
        return numbers(pc.day_of_week(self.rows[name]))

    def dayofmonth(self, name: str) -> np.ndarray:
        return numbers(pc.day(self.rows[name]))

    def month(self, name: str) -> np.ndarray:
        return numbers(pc.month(self.rows[name]))

    sqrt, abs, sign, square, where = staticmethod(np.sqrt), staticmethod(np.abs), staticmethod(np.sign), staticmethod(np.square), staticmethod(np.where)

    @staticmethod
    def ln(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, np.log(x), np.nan)

    @staticmethod
    def ratio(a: np.ndarray | float, b: np.ndarray) -> np.ndarray:
        return np.where(b == 0, np.nan, a / b)

    @staticmethod
    def tidy(x: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(x), x, np.nan)

    @staticmethod
    def positive_part(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x, 0.0)

    @staticmethod
    def negative_part(x: np.ndarray) -> np.ndarray:
        return np.where(x < 0, -x, 0.0)

    def delay(self, x: np.ndarray, k: int) -> np.ndarray:
        return np.where(self.place >= k, back(x, k), np.nan)

    def delta(self, x: np.ndarray, k: int) -> np.ndarray:
        return x - self.delay(x, k)

    def returns(self, x: np.ndarray) -> np.ndarray:
        return self.ratio(x, self.delay(x, 1)) - 1

    def log_return(self, x: np.ndarray) -> np.ndarray:
        return self.ln(self.ratio(x, self.delay(x, 1)))


def ahead(values: np.ndarray, k: int) -> np.ndarray:
    """The values k rows later; NaN where there are none."""
    return back(values[::-1].astype(float), k)[::-1]


def each_day(columns: list[str], most: int = 14_000):
    """The function for ``mapInArrow`` that makes of each row, which lasts ``_days`` days from its ``date`` on, a row for each of these from Monday to Friday, with volume 0 after the first day.

    About ``most`` days at once, however long rows last.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, low = np.cumsum(batch.column("_days").to_numpy()), 0
            while low < len(ends):
                begun = ends[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(ends, begun + most, "right")))
                lasts = np.diff(ends[low:high], prepend=begun)
                of = np.repeat(np.arange(len(lasts)), lasts)
                after = np.arange(len(of)) - (ends[low:high] - lasts - begun)[of]
                rows = batch.slice(low, high - low)
                day = rows.column("date").cast(pa.int32()).to_numpy()[of] + after.astype(np.int32)
                work = (day + 3) % 7 < 5  # day 0 was a Thursday
                new = rows.select(columns).take(pa.array(of[work]))
                new = new.set_column(columns.index("date"), new.schema.field("date"), pa.array(day[work], pa.int32()).cast(pa.date32()))
                volume = pc.if_else(pa.array(after[work] == 0), new.column("volume"), pa.scalar(0, new.column("volume").type))
                yield new.set_column(columns.index("volume"), new.schema.field("volume"), volume)
                low = high

    return fill


def panel_rows(values: Callable[[Arrays], list[np.ndarray]], names: list[str], scaled: list[str], narrow: list[str], key: str, past: int, n: int, limit: float, horizon: int, kept: Callable[[Arrays, np.ndarray], np.ndarray] | None, seen: int, schema: pa.Schema):
    """The function for ``mapInArrow`` that makes rows of a panel of bars in order: the bars, ``names`` as ``values`` gives them, ``target``.

    Those of ``scaled`` are normalised; those of ``narrow`` go into one list of floats, ``_narrow``, and stand nowhere else. Of the rows for which
    ``kept`` holds, which is told the bars and the target, a key's first ``seen`` are left out. A row waits for the ``horizon`` rows after it.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = [names.index(c) for c in scaled]
        normalised, waiting, count = Normal(len(scaled), n, limit), np.zeros((len(names), 0)), 0
        rows = bars = starts = None

        def out(found: np.ndarray, target: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
            nonlocal count
            here = slice(first, first + found.shape[1])
            ok = np.ones(found.shape[1], bool) if kept is None else kept(bars, target)[here]
            so_far = np.cumsum(ok)
            alone = np.maximum.accumulate(np.where(starts[here], so_far - ok, -count))  # those before the key's first row here; the key going on brings its own
            so_far = so_far - alone
            count = int(so_far[-1])
            at = np.flatnonzero(ok & (so_far > seen))
            if not len(at):
                return
            taken = rows.take(pa.array(at + first))
            columns = {c: taken[c].combine_chunks() for c in taken.column_names}
            columns |= {c: doubles(found[i, at]) for i, c in enumerate(names)} | {"target": doubles(target[here][at])}
            if narrow:
                cells = found[[names.index(c) for c in narrow]][:, at].T.astype(np.float32)
                columns["_narrow"] = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * len(narrow), cells.ravel())
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)

        for rows, old, place, starts in with_past(batches, key, max(past, n, horizon)):
            bars = Arrays(rows, place, starts)
            with np.errstate(all="ignore"):
                fresh = np.stack([x[old:] for x in values(bars)])
                if scaled:
                    fresh[order] = normalised(fresh[order], place, None if kept is None else kept(bars, np.zeros(rows.num_rows))[old:])
                target = np.where(ahead(place, horizon) >= horizon, bars.ratio(ahead(bars("close"), horizon), ahead(bars("open"), 1)) - 1, np.nan)
            first = old - waiting.shape[1]
            found = np.concatenate([waiting, fresh], 1)
            ready = max(0, found.shape[1] - horizon)
            if ready:
                yield from out(found[:, :ready], target, first)
            waiting = found[:, ready:]
        if waiting.shape[1]:
            yield from out(waiting, np.full(rows.num_rows, np.nan), rows.num_rows - waiting.shape[1])

    return make


def windows(features: list[str], key: str, length: int, label: bool, schema: pa.Schema):
    """The function for ``mapInArrow`` that makes a sample of each row with ``_keep`` and the length - 1 rows before it."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, old, place, _ in with_past(batches, key, length - 1):
            ends = np.flatnonzero(rows["_keep"].to_numpy() & (place >= length - 1) & (np.arange(rows.num_rows) >= old))
            if not len(ends):
                continue
            at, n, k = ends[:, None] - np.arange(length - 1, -1, -1), rows.num_rows, len(features)
            flat = pa.concat_arrays([pc.cast(rows[f].combine_chunks(), pa.float32(), safe=False) for f in features])
            cells = flat.take(pa.array((at[:, :, None] + np.arange(k) * n).ravel()))
            bars = pa.ListArray.from_arrays(np.arange(len(ends) * length + 1, dtype=np.int32) * k, cells)
            past = pa.ListArray.from_arrays(np.arange(len(ends) + 1, dtype=np.int32) * length, bars)
            first, last = rows.take(pa.array(at[:, 0])), rows.take(pa.array(ends))
            columns = [last[key], first["date"], last["date"], past, *([last["_label"]] if label else [])]
            yield from pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=schema).to_batches()

    return make
