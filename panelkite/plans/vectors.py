"""Trees on NumPy arrays: many windows in one pass over the rows of a partition.

Spark evaluates each frame of a sliding window anew.  Here a frame of d slots is
put together from two shorter ones, the older shifted to its place, so that the
frames of all sizes over a series cost a few additions a row.  Sums are added in
pairs, variances are merged from means and squared deviations: nothing is ever
taken off a running total.  Rows come in batches of any size, and each batch
sees as many rows before it as the expressions look back, so memory doesn't
depend on an instrument's length.

NULL is NaN in these arrays.  A field's own NaN is told apart by a mask.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa

from panelkite.functions import registry
from panelkite.functions.rolling import FLAT
from panelkite.plans import extent
from panelkite.plans.compiler import is_decay
from panelkite.plans.tree import Call, Field, Literal, Node

ARITHMETIC = {"Add": np.add, "Sub": np.subtract, "Mul": np.multiply}
COMPARISONS = ("Gt", "Ge", "Lt", "Le")
FRAMES = ("Mean", "Sum", "Std", "Max", "Min", "IdxMax", "IdxMin", "Rank", "Slope", "Rsquare", "Resi", "Quantile", "Corr")
#: Results of these are doubles, whatever the fields are.
DOUBLES = {*ARITHMETIC, "Div", "Greater", "Less", "Abs", "Log", *FRAMES}
#: The slots, as a series.
AT = -1
#: Rows that are worked on at a time, where batches are larger.
ROWS = 10_000
#: And so many values of results at a time: wide sets take fewer rows.
CELLS = 1_600_000
#: So many values of frames are sorted at a time.
SORTED = 2**16
#: (operator, places of its arguments, numbers)
Step = tuple[str, tuple[int, ...], tuple]


def fit(trees: Iterable[Node]) -> bool:
    """Whether all that the trees ask for is here: frames of a fixed size, no look into the future, no users' operators."""

    def known(node: Node) -> bool:
        if isinstance(node, Literal):
            return isinstance(node.value, int | float) and not isinstance(node.value, bool)
        if not isinstance(node, Call):
            return isinstance(node, Field)
        if node.name in registry.CUSTOM or is_decay(node) or node.name not in DOUBLES | {"Ref", *COMPARISONS}:
            return False
        numbers = node.args[_series(node) :]
        if node.name in FRAMES or node.name == "Ref":
            return len(numbers) == 1 + (node.name == "Quantile") and all(isinstance(n, Literal) for n in numbers) and isinstance(numbers[0].value, int) and numbers[0].value > 0
        return not numbers

    return all(isinstance(t, Call) and t.name in DOUBLES and all(map(known, t.walk())) for t in trees)


def _series(call: Call) -> int:
    """How many arguments come before an operator's numbers."""
    return {"Corr": 2}.get(call.name, 1) if call.name in FRAMES or call.name == "Ref" else len(call.args)


def compiled(trees: Mapping[str, Node]) -> tuple[list[Step], dict[str, int]]:
    """Each distinct node once, after those it asks for, and the places of the trees."""
    place: dict[Node, int] = {}
    steps: list[Step] = []
    for root in trees.values():
        for node in root.walk():
            if node in place:
                continue
            if isinstance(node, Field):
                step: Step = ("field", (), (node.name,))
            elif isinstance(node, Literal):
                step = ("literal", (), (float(node.value),))
            else:
                n = _series(node)
                step = (node.name, tuple(place[a] for a in node.args[:n]), tuple(a.value for a in node.args[n:]))
            place[node] = len(steps)
            steps.append(step)
    return steps, {name: place[t] for name, t in trees.items()}


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As elementwise.rounded()."""
    scale = 10.0**digits
    rest = x * scale
    np.abs(rest, out=rest)
    far = np.isinf(rest)
    out = np.rint(rest)
    rest -= out
    out += rest >= 0.5
    out /= scale
    np.copysign(out, x, out=out)
    out += 0.0
    if far.any():
        out[far] = x[far]
    return out


def fused(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """a * b + c, rounded once, as DuckDB interpolates: halves that rounding meets fall the same way."""
    (a1, a2), (b1, b2) = _halves(a), _halves(b)
    product = a * b
    lost = a2 * b2 - (((product - a1 * b1) - a2 * b1) - a1 * b2)
    total = product + c
    part = total - product
    out = total + (((product - (total - part)) + (c - part)) + lost)
    return np.where(np.isfinite(out), out, total)


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper and the lower half of a number's bits; their products are exact."""
    high = x * 134217729.0
    high = high - (high - x)
    return high, x - high


class Batch:
    """The steps over some rows.  before: for each row, how many its instrument has before it."""

    def __init__(self, steps: Sequence[Step], fields: Mapping[str, np.ndarray], real: Mapping[str, np.ndarray], slot: np.ndarray, before: np.ndarray):
        self.steps, self.fields, self.slot, self.before = steps, fields, slot, before
        self.size = len(slot)
        self.index = np.arange(self.size)
        self.sizes = {numbers[0] for name, _, numbers in steps if name in FRAMES}
        self.memo: dict[tuple, object] = {}
        self.patterns: dict[bytes, int] = {}
        self.missing: list[np.ndarray] = []
        #: Where a value is a field's own NaN, not NULL.
        self.real: dict[int, np.ndarray] = {}
        self.values: list = []
        with np.errstate(all="ignore"):
            for i, (name, args, numbers) in enumerate(steps):
                if name == "field":
                    if real[numbers[0]].any():
                        self.real[i] = real[numbers[0]]
                    self.values.append(fields[numbers[0]])
                else:
                    self.values.append(self._made(i, name, args, numbers))

    def _made(self, i: int, name: str, args: tuple[int, ...], numbers: tuple) -> np.ndarray | float:
        if name == "literal":
            return numbers[0]
        if name in FRAMES:
            return getattr(self, f"_{name.lower()}")(*args, *numbers)
        own = [np.asarray(self.values[a], float) for a in args]
        marks = [self.real.get(a) for a in args]
        marked = any(m is not None for m in marks)
        if name in ARITHMETIC:
            return ARITHMETIC[name](*own)
        if name == "Div":
            return self._div(*own, marks[0])
        if name in COMPARISONS:
            return _compared(name, *own, *marks) if marked else {"Gt": np.greater, "Ge": np.greater_equal, "Lt": np.less, "Le": np.less_equal}[name](*own)
        if name == "Ref":
            if marked:
                self.real[i] = self.shifted(marks[0], numbers[0], False)
            return self.shifted(own[0] if own[0].ndim else np.full(self.size, own[0]), numbers[0], np.nan)
        if name in ("Greater", "Less"):
            out = (np.maximum if name == "Greater" else np.minimum)(*own)
            if marked:
                (a, b), (ra, rb) = own, [np.zeros(self.size, bool) if m is None else m for m in marks]
                only_a, only_b = ra & ~np.isnan(b), rb & ~np.isnan(a)
                self.real[i] = ra & rb
                if name == "Greater":
                    self.real[i] |= only_a | only_b
                else:
                    out = np.where(only_a, b, np.where(only_b, a, out))
            return out
        if marked:
            self.real[i] = marks[0]
        if name == "Abs":
            return np.abs(own[0])
        return np.where(own[0] >= 0, np.log(own[0]), np.nan)

    def _div(self, a: np.ndarray, b: np.ndarray, real: np.ndarray | None) -> np.ndarray:
        out, zero = a / b, b == 0
        if not zero.any():
            return out
        above = a > 0 if real is None else (a > 0) | real
        return np.where(zero, np.where(above, np.inf, np.where(a < 0, -np.inf, np.nan)), out)

    # Series and frames

    def early(self, k: int) -> np.ndarray:
        """Rows whose instrument has no row k before them."""
        key = ("early", k)
        if key not in self.memo:
            self.memo[key] = np.flatnonzero((self.before < k) | (self.index < k))
        return self.memo[key]

    def shifted(self, x: np.ndarray, k: int, fill: float | bool) -> np.ndarray:
        out = np.empty_like(x)
        out[k:] = x[: max(self.size - k, 0)]
        out[self.early(k)] = fill
        return out

    def parts(self, d: int) -> tuple[int, int]:
        """Sizes of the newer and the older part of a frame."""
        newer = max((s for s in self.sizes if s < d <= 2 * s), default=(d + 1) // 2)
        return newer, d - newer

    def merged(self, what: str, key: tuple, d: int, first: Callable, join: Callable):
        """The frame of d slots: first() of one slot, join(newer, older, sizes) of two parts."""
        at = (what, key, d)
        if at not in self.memo:
            if d == 1:
                self.memo[at] = first()
            else:
                a, b = self.parts(d)
                self.memo[at] = join(self.merged(what, key, a, first, join), self.merged(what, key, b, first, join), a, b)
        return self.memo[at]

    def pattern(self, missing: np.ndarray) -> int:
        """A number for these missing rows: series that miss the same rows share their counts."""
        at = self.patterns.setdefault(missing.tobytes(), len(self.missing))
        if at == len(self.missing):
            self.missing.append(missing)
        return at

    def clean(self, i: int) -> tuple[np.ndarray, int]:
        """A series as windows see it, without infinities, and its pattern."""
        key = ("clean", i)
        if key not in self.memo:
            x = np.array(np.broadcast_to(np.asarray(self.values[i], float), self.size))
            missing = ~np.isfinite(x)
            x[missing] = np.nan
            self.memo[key] = x, self.pattern(missing)
        return self.memo[key]

    def filled(self, i: int, p: int) -> np.ndarray:
        """A series with 0 where the pattern misses rows."""
        key = ("filled", i, p)
        if key not in self.memo:
            x = (self.slot if i == AT else self.clean(i)[0]).copy()
            x[self.missing[p]] = 0.0
            self.memo[key] = x
        return self.memo[key]

    def counts(self, p: int, d: int) -> np.ndarray:
        return self.merged("n", (p,), d, lambda: (~self.missing[p]).astype(float), lambda new, old, a, b: new + self.shifted(old, a, 0.0))

    def shares(self, p: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the older part of a frame: its share of the values, and this times the number of newer values."""
        key = ("shares", p, a, b)
        if key not in self.memo:
            new, old = self.counts(p, a), self.shifted(self.counts(p, b), a, 0.0)
            share = old / np.maximum(new + old, 1.0)
            self.memo[key] = share, share * new
        return self.memo[key]

    def sums(self, i: int, d: int) -> np.ndarray:
        p = self.clean(i)[1]
        return self.merged("sum", (i,), d, lambda: self.filled(i, p), lambda new, old, a, b: new + self.shifted(old, a, 0.0))

    def moments(self, i: int, p: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Mean, squared deviations, and the older part's mean less the newer one's."""

        def join(new: tuple, old: tuple, a: int, b: int) -> tuple:
            share, both = self.shares(p, a, b)
            apart = self.shifted(old[0], a, 0.0) - new[0]
            return new[0] + apart * share, new[1] + self.shifted(old[1], a, 0.0) + apart * apart * both, apart

        return self.merged("moments", (i, p), d, lambda: (self.filled(i, p), np.zeros(self.size), None), join)

    def products(self, i: int, j: int, p: int, d: int) -> np.ndarray:
        """Products of both deviations."""

        def join(new: np.ndarray, old: np.ndarray, a: int, b: int) -> np.ndarray:
            apart = self.moments(i, p, a + b)[2] * self.moments(j, p, a + b)[2]
            return new + self.shifted(old, a, 0.0) + apart * self.shares(p, a, b)[1]

        return self.merged("products", (i, j, p), d, lambda: np.zeros(self.size), join)

    def _sum(self, i: int, d: int) -> np.ndarray:
        return np.where(self.counts(self.clean(i)[1], d) > 0, self.sums(i, d), np.nan)

    def _mean(self, i: int, d: int) -> np.ndarray:
        return self.sums(i, d) / self.counts(self.clean(i)[1], d)

    def _std(self, i: int, d: int) -> np.ndarray:
        p = self.clean(i)[1]
        n = self.counts(p, d)
        return np.where(n > 1, np.sqrt(self.moments(i, p, d)[1] / (n - 1)), np.nan)

    def _max(self, i: int, d: int) -> np.ndarray:
        return self.merged("max", (i,), d, lambda: self.clean(i)[0], lambda new, old, a, b: np.fmax(new, self.shifted(old, a, np.nan)))

    def _min(self, i: int, d: int) -> np.ndarray:
        return self.merged("min", (i,), d, lambda: self.clean(i)[0], lambda new, old, a, b: np.fmin(new, self.shifted(old, a, np.nan)))

    def _place(self, i: int, d: int, sign: float) -> np.ndarray:
        """1-based place of the first extreme; a missing value wins over any number."""

        def first() -> tuple:
            x = sign * self.clean(i)[0]
            x[np.isnan(x)] = np.inf
            return x, np.zeros(self.size)

        def join(new: tuple, old: tuple, a: int, b: int) -> tuple:
            best = self.shifted(old[0], a, -np.inf)
            return np.maximum(best, new[0]), np.where(best >= new[0], self.shifted(old[1], a, 0.0) + a, new[1])

        age = self.merged("place", (i, sign), d, first, join)[1]
        return np.where(self.counts(self.clean(i)[1], d) > 0, np.minimum(self.before + 1, d) - age, np.nan)

    def _idxmax(self, i: int, d: int) -> np.ndarray:
        return self._place(i, d, 1.0)

    def _idxmin(self, i: int, d: int) -> np.ndarray:
        return self._place(i, d, -1.0)

    def _rank(self, i: int, d: int) -> np.ndarray:
        """From the values below and those not above, counted for all sizes in one walk back."""
        x, p = self.clean(i)
        if ("rank", i, d) not in self.memo:
            wanted = {numbers[0] for name, args, numbers in self.steps if name == "Rank" and args == (i,)}
            found = np.zeros(self.size, np.int16 if 2 * max(wanted) < 2**15 else np.int64)
            found += x <= x
            for k in range(max(wanted)):
                if 0 < k < self.size:
                    now, then, inside = x[k:], x[:-k], self.before[k:] >= k
                    found[k:] += (then < now) & inside
                    found[k:] += (then <= now) & inside
                if k + 1 in wanted:
                    self.memo["rank", i, k + 1] = found.copy()
        return np.where(np.isnan(x), np.nan, (self.memo["rank", i, d] + 1) / 2 / self.counts(p, d))

    def _quantile(self, i: int, d: int, q: float) -> np.ndarray:
        """Frames are sorted some rows at a time, once for all shares that are asked for."""
        if ("quantile", i, d, q) not in self.memo:
            x, p = self.clean(i)
            n, ages = self.counts(p, d), np.arange(d - 1, -1, -1)
            shares = {numbers[1] for name, args, numbers in self.steps if name == "Quantile" and args == (i,) and numbers[0] == d}
            found = {s: np.empty(self.size) for s in shares}
            frames = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(d - 1, np.nan), x]), d)
            many = max(SORTED // d, 1)
            for start in range(0, self.size, many):
                rows = slice(start, start + many)
                own = frames[rows].copy()
                few = np.flatnonzero(self.before[rows] < d - 1)
                own[few] = np.where(ages > self.before[rows][few, None], np.nan, own[few])
                own.sort(axis=1)
                for share, out in found.items():
                    place = np.maximum(n[rows] - 1, 0.0) * share
                    low = np.floor(place)
                    below, above = (own[np.arange(len(own)), at.astype(np.int64)] for at in (low, np.ceil(place)))
                    out[rows] = np.where(below == above, below, fused(below, 1 - (place - low), above * (place - low)))
            self.memo |= {("quantile", i, d, share): out for share, out in found.items()}
        return self.memo["quantile", i, d, q]

    def _corr(self, i: int, j: int, d: int) -> np.ndarray:
        p, other = self.clean(i)[1], self.clean(j)[1]
        moves = (self._std(i, d) > FLAT) & (self._std(j, d) > FLAT)
        if p != other:
            p = self.pattern(self.missing[p] | self.missing[other])
        n = self.counts(p, d)
        spread = np.sqrt(self.moments(i, p, d)[1] / n) * np.sqrt(self.moments(j, p, d)[1] / n)
        return np.where(moves & (spread != 0), self.products(i, j, p, d) / n / spread, np.nan)

    def _slope(self, i: int, d: int) -> np.ndarray:
        key = ("slope", i, d)
        if key not in self.memo:
            p = self.clean(i)[1]
            slope = self.products(i, AT, p, d) / self.moments(AT, p, d)[1]
            self.memo[key] = np.where(self.counts(p, d) > 1, slope, np.nan)
        return self.memo[key]

    def _resi(self, i: int, d: int) -> np.ndarray:
        x, p = self.clean(i)
        return x - self.moments(i, p, d)[0] - self._slope(i, d) * (self.slot - self.moments(AT, p, d)[0])

    def _rsquare(self, i: int, d: int) -> np.ndarray:
        p = self.clean(i)[1]
        both = self.products(i, AT, p, d)
        value = both * both / (self.moments(AT, p, d)[1] * self.moments(i, p, d)[1])
        return np.where(self._std(i, d) > FLAT, value, np.nan)


def _compared(name: str, a: np.ndarray, b: np.ndarray, ra: np.ndarray | None, rb: np.ndarray | None) -> np.ndarray:
    """As Spark compares: NaN is above all numbers and equals itself."""
    ra, rb = (np.zeros(len(ra if ra is not None else rb), bool) if m is None else m for m in (ra, rb))
    if name in ("Lt", "Le"):
        a, b, ra, rb = b, a, rb, ra
    above = (a > b) | (ra & ~np.isnan(b))
    return above if name in ("Gt", "Lt") else above | (a == b) | (ra & rb)


def over_batches(trees: Mapping[str, Node], digits: int | None, keys: Sequence[str], slot: str, before: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: rows of whole instruments in order of their slots, with `before` rows of the instrument each."""
    steps, places = compiled(trees)
    names = sorted({numbers[0] for name, _, numbers in steps if name == "field"})
    back = max((int(extent.extent(t)[0]) for t in trees.values()), default=0)
    many = max(min(ROWS, CELLS // max(len(trees), 1)), 1)

    def read(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (slot, before)}
        for c in names:
            column = batch.column(c)
            out[c] = column.to_numpy(zero_copy_only=False).astype(float)
            out[f"real {c}"] = np.isnan(out[c]) & column.is_valid().to_numpy(zero_copy_only=False)
        return out

    def column(batch: Batch, place: int, start: int) -> pa.Array:
        x = np.asarray(batch.values[place], float)
        x = (x if x.ndim else np.full(batch.size, x))[start:]
        null = np.isnan(x)
        if place in batch.real:
            null &= ~batch.real[place][start:]
        with np.errstate(all="ignore"):
            return pa.array(x if digits is None else rounded(x, digits), pa.float64(), mask=null)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in (b.slice(i, many) for b in batches for i in range(0, b.num_rows, many)):
            rows = read(batch)
            start = len(held[slot]) if held else 0
            if held:
                rows = {c: np.concatenate([held[c], x]) for c, x in rows.items()}
            held = {c: x[max(len(x) - back, 0) :] for c, x in rows.items()}
            done = Batch(steps, {c: rows[c] for c in names}, {c: rows[f"real {c}"] for c in names}, rows[slot].astype(float), rows[before])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(column(done, p, start) for p in places.values())], names=[*keys, *places])

    return run
