"""Sequential trading simulation: one fold over a run's days.

A run is a set of rows with one run_id; runs are simulated side by side, one
task each that reads its days in order, and a run's prices and scores are
joined before.  State (cash and
positions) is carried from day to day inside the fold.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkite.plans.compiler import INSTRUMENT, TIME


@dataclass(frozen=True)
class Costs:
    """Rates of an exchange."""

    open: float = 0.0015
    close: float = 0.0025
    least: float = 5.0
    impact: float = 0.0
    unit: float | None = None


@dataclass
class Book:
    """Cash and amounts, and for how many steps each has been held."""

    cash: float
    amounts: dict = field(default_factory=dict)
    held: dict = field(default_factory=dict)

    def value(self, prices: Mapping) -> float:
        return self.cash + sum(a * prices[i] for i, a in self.amounts.items())


def rounded(amount: float, factor: float, unit: float | None) -> float:
    """Down to whole units of the unadjusted share."""
    if unit is None or not factor or math.isnan(factor):
        return amount
    return (amount * factor + 0.1) // unit * unit / factor


def deal(book: Book, who: object, amount: float, buy: bool, price: float, costs: Costs, volume: float = math.nan, factor: float = 1.0, limit: float | None = None) -> tuple[float, float, float]:
    """Trades as much of an order as cash, holdings and volume allow: (amount, value, cost)."""
    if not price or math.isnan(price):
        return 0.0, 0.0, 0.0
    if limit is not None:
        amount = min(amount, max(limit, 0.0))
    market = volume * price
    impact = costs.impact if not market or math.isnan(market) else costs.impact * (amount * price / market) ** 2
    rate = (costs.open if buy else costs.close) + impact
    fee = lambda a: max(a * price * rate, costs.least)
    if buy:
        if book.cash < fee(amount):
            amount = 0.0
        elif book.cash < amount * price + fee(amount):
            # Either the rate or the least fee decides what can be paid.
            whole = book.cash / (1 + rate) / price
            if whole * price * rate < costs.least:
                whole = (book.cash - costs.least) / price
            amount = rounded(min(whole, amount), factor, costs.unit)
        else:
            amount = rounded(amount, factor, costs.unit)
    else:
        own = book.amounts.get(who, 0.0)
        if not np.isclose(amount, own):
            amount = rounded(min(own, amount), factor, costs.unit)
        if book.cash + amount * price < fee(amount):
            amount = 0.0
    value = amount * price
    cost = 0.0 if value <= 1e-5 else fee(amount)
    if value > 1e-5:
        if buy:
            book.amounts[who] = book.amounts.get(who, 0.0) + amount
            book.held.setdefault(who, 0)
            book.cash -= value + cost
        else:
            left = book.amounts.get(who, 0.0) - amount
            book.cash += value - cost
            if np.isclose(left, 0):
                book.amounts.pop(who, None)
                book.held.pop(who, None)
            else:
                book.amounts[who] = left
    return amount, value, cost


def tradable_flags(rows: DataFrame, limit: float | None = None, close: str = "close", change: str = "change") -> DataFrame:
    """rows with suspended, no_buy and no_sell; limits are moves of at least `limit` up or down."""
    suspended = F.col(close).isNull() | F.isnan(close)
    move = F.col(change) if change in rows.columns else F.lit(None).cast("double")
    none = F.lit(False)
    up, down = (none, none) if limit is None else (F.coalesce(move >= limit, none), F.coalesce(move <= -limit, none))
    return rows.withColumns({"suspended": suspended, "no_buy": suspended | up, "no_sell": suspended | down})


def deal_price(wanted: Column, close: Column) -> Column:
    """The wanted price, or the close where it is missing or next to nothing."""
    return F.when(wanted.isNull() | F.isnan(wanted) | (wanted <= 1e-8), close).otherwise(wanted)


@dataclass(frozen=True)
class TopDrop:
    """Holds the k best scores and exchanges at most n of them a day, by the scores of the day before."""

    k: int = 10
    n: int = 2
    risk: float = 0.95
    hold: int = 1
    only_tradable: bool = False

    def orders(self, book: Book, scores: pd.Series, day: pd.DataFrame) -> tuple[list, list]:
        """(to sell, to buy)."""
        if self.only_tradable:
            scores = scores[[i in day.index and not day.at[i, "suspended"] for i in scores.index]]
        ranked = scores.sort_values(ascending=False, kind="stable")
        own = [i for i in ranked.index if i in book.amounts] + [i for i in book.amounts if i not in ranked.index]
        fresh = [i for i in ranked.index if i not in book.amounts][: max(self.n + self.k - len(own), 0)]
        both = [i for i in ranked.index if i in set(own) | set(fresh)] + [i for i in own if i not in ranked.index]
        worst = set(both[-self.n :]) if self.n else set()
        sell = [i for i in own if i in worst]
        return sell, fresh[: max(len(sell) + self.k - len(own), 0)]


def soft_weights(scores: Mapping, current: Mapping, k: int, risk: float = 1.0, most_move: float = 1.0) -> dict:
    """Equal target weights of the k best, approached by at most `most_move` of weight sold, the proceeds bought in proportion."""
    best = sorted(scores, key=lambda i: (-scores[i], str(i)))[:k]
    ideal = dict.fromkeys(best, risk / len(best)) if best else {}
    out, freed = {}, risk - sum(current.values())
    for i, w in current.items():
        sold = min(max(w - ideal.get(i, 0.0), 0.0), most_move)
        freed += sold
        if w - sold > 1e-12:
            out[i] = w - sold
    want = {i: max(t - out.get(i, 0.0), 0.0) for i, t in ideal.items()}
    total = sum(want.values())
    for i, w in want.items():
        if total > 0 and w > 0:
            out[i] = out.get(i, 0.0) + min(w, w / total * max(freed, 0.0))
    return out


def best_of_dates(rows: DataFrame, k: int, keys: tuple[str, ...] = (TIME,)) -> DataFrame:
    """Each date's k best scores, ties by the instrument's name: all that soft weights ask of a date."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col(INSTRUMENT).cast("string"))
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def wanted_rows(rows: DataFrame, strategy: TopDrop) -> DataFrame:
    """The rows that a run can ask for: all of the instruments that are among a date's best at some date, and some row of each date.

    A run holds n + k instruments at most and buys from the n + k best others,
    so whatever it buys is among a date's 2 (n + k) best.  They are few.
    """
    if strategy.only_tradable:
        return rows
    score = F.when(~F.isnan("score"), F.col("score") + 0.0)
    order = Window.partitionBy("run_id", TIME).orderBy(score.desc_nulls_last(), INSTRUMENT)
    best = rows.select("run_id", TIME, INSTRUMENT, "score").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= 2 * (strategy.n + strategy.k))
    return rows.join(F.broadcast(best.select("run_id", INSTRUMENT).distinct()), ["run_id", INSTRUMENT], "left_semi")


def backtest(rows: DataFrame, strategy: TopDrop = TopDrop(), costs: Costs = Costs(), cash: float = 1e8, limit: float | None = None) -> DataFrame:
    """(run_id, datetime, account, return, turnover, cost, value, cash, n_held) from rows (run_id, datetime, instrument, close, score[, change, volume, factor]).

    A run's rows go through one task in order of their days, of which it holds one at a time.
    """
    flagged = tradable_flags(wanted_rows(rows.where(F.col(TIME).isNotNull()), strategy), limit)
    for name, default in (("volume", None), ("factor", 1.0)):
        if name not in flagged.columns:
            flagged = flagged.withColumn(name, F.lit(default).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run_id, days in itertools.groupby(_days(batches), lambda day: day["run_id"].iloc[0]):
            yield from _packed(_folded(run_id, ((day[TIME].iloc[0], day) for day in days), strategy, costs, cash))

    kind = dict(rows.dtypes)
    schema = f"run_id {kind['run_id']}, {TIME} timestamp_ntz, account double, `return` double, turnover double, cost double, value double, cash double, n_held bigint"
    columns = flagged.select("run_id", TIME, INSTRUMENT, "close", "score", "volume", "factor", "suspended", "no_buy", "no_sell")
    return columns.repartition("run_id").sortWithinPartitions("run_id", TIME, INSTRUMENT).mapInArrow(run, schema)


def _days(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """The days of runs, from rows in order of run and day."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        frame = batch.to_pandas()
        if not len(frame):
            continue
        new = ((frame["run_id"] != frame["run_id"].shift()) | (frame[TIME] != frame[TIME].shift())).to_numpy()
        if held:
            new[0] = held[-1]["run_id"].iloc[-1] != frame["run_id"].iloc[0] or held[-1][TIME].iloc[-1] != frame[TIME].iloc[0]
        starts = np.flatnonzero(new)
        for first, end in zip([0, *starts], [*starts, len(frame)], strict=True):
            if first in starts and held:
                yield pd.concat(held)
                held = []
            if end > first:
                held.append(frame.iloc[first:end])
    if held:
        yield pd.concat(held)


def _packed(results: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    names = ["run_id", TIME, "account", "return", "turnover", "cost", "value", "cash", "n_held"]
    for some in itertools.batched(results, 10_000):
        columns = [pa.array(c) for c in zip(*some, strict=True)]
        columns[1] = pa.array([pd.Timestamp(row[1]).to_pydatetime() for row in some], pa.timestamp("us"))
        columns[2:8] = [pa.array([row[i] for row in some], pa.float64()) for i in range(2, 8)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _folded(run_id: object, days: Iterable[tuple], strategy: TopDrop, costs: Costs, cash: float) -> Iterator[tuple]:
    """One run, day by day."""
    book, last, seen = Book(cash), cash, {}
    before: pd.Series | None = None
    for when, rows in days:
        day = rows.set_index(INSTRUMENT)
        seen.update({i: p for i, p in day["close"].items() if p == p})
        traded = cost = 0.0
        if before is not None and len(before):
            sell, buy = strategy.orders(book, before, day)
            for i in sell:
                if i in day.index and not day.at[i, "no_sell"] and book.held.get(i, 0) >= strategy.hold:
                    _, v, c = deal(book, i, book.amounts[i], False, day.at[i, "close"], costs, day.at[i, "volume"], day.at[i, "factor"])
                    traded, cost = traded + v, cost + c
            share = book.cash * strategy.risk / len(buy) if buy else 0.0
            for i in buy:
                if i in day.index and not day.at[i, "no_buy"]:
                    price = day.at[i, "close"]
                    _, v, c = deal(book, i, rounded(share / price, day.at[i, "factor"], costs.unit), True, price, costs, day.at[i, "volume"], day.at[i, "factor"])
                    traded, cost = traded + v, cost + c
        now = book.value(seen)
        for i in book.held:
            book.held[i] += 1
        yield run_id, when, float(now), float((now - last + cost) / last), float(traded / last), float(cost / last), float(now - book.cash), float(book.cash), len(book.amounts)
        last = now
        before = day["score"].dropna()


def fold(frame: pd.DataFrame, strategy: TopDrop, costs: Costs, cash: float) -> pd.DataFrame:
    """One run in memory."""
    days = frame.sort_values([TIME, INSTRUMENT]).groupby(TIME, sort=True)
    return pd.DataFrame(_folded(frame["run_id"].iloc[0], days, strategy, costs, cash), columns=["run_id", TIME, "account", "return", "turnover", "cost", "value", "cash", "n_held"])


def orders_fold(frame: pd.DataFrame, orders: pd.DataFrame, costs: Costs, cash: float) -> pd.DataFrame:
    """Orders from a file (datetime, instrument, amount, direction buy or sell) at each day's close: what was dealt."""
    book, out = Book(cash), []
    prices = {(r.datetime, r.instrument): r for r in frame.itertuples()}
    for o in orders.sort_values([TIME]).itertuples():
        row = prices.get((o.datetime, o.instrument))
        done = deal(book, o.instrument, o.amount, o.direction == "buy", row.close, costs, getattr(row, "volume", math.nan), getattr(row, "factor", 1.0)) if row is not None else (0.0, 0.0, 0.0)
        out.append((o.datetime, o.instrument, o.direction, o.amount, *done, done[0] / o.amount if o.amount else math.nan, book.cash))
    return pd.DataFrame(out, columns=[TIME, INSTRUMENT, "direction", "amount", "deal_amount", "value", "cost", "ffr", "cash"])


def sliced(orders: DataFrame, slots: int) -> DataFrame:
    """Orders in equal parts, one a slot (TWAP): rows with slot 0 to slots - 1 and that part's amount."""
    return orders.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("amount", F.col("amount") / slots)


def target_orders(current: DataFrame, target: DataFrame) -> DataFrame:
    """(instrument, amount, direction) that turn current amounts (instrument, amount) into target ones."""
    both = current.select(INSTRUMENT, F.col("amount").alias("_a")).join(target.select(INSTRUMENT, F.col("amount").alias("_b")), INSTRUMENT, "full")
    gap = F.coalesce("_b", F.lit(0.0)) - F.coalesce("_a", F.lit(0.0))
    return both.select(INSTRUMENT, F.abs(gap).alias("amount"), F.when(gap > 0, "buy").otherwise("sell").alias("direction")).where(F.col("amount") > 0)


def weights_inverse(cov: np.ndarray) -> np.ndarray:
    w = 1 / np.diag(cov)
    return w / w.sum()


def weights_least_variance(cov: np.ndarray) -> np.ndarray:
    """Long-only, by projected gradients."""
    return _descend(lambda w: cov @ w, len(cov))


def weights_mean_variance(mean: np.ndarray, cov: np.ndarray, aversion: float = 1.0) -> np.ndarray:
    return _descend(lambda w: aversion * cov @ w - mean, len(cov))


def weights_risk_parity(cov: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Equal shares of the total risk, by cyclic coordinate descent."""
    n = len(cov)
    w = np.ones(n) / n
    for _ in range(rounds):
        for i in range(n):
            rest = cov[i] @ w - cov[i, i] * w[i]
            w[i] = (-rest + math.sqrt(rest * rest + 4 * cov[i, i] / n)) / (2 * cov[i, i])
    return w / w.sum()


def _simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    c = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
    return np.maximum(v - c[np.flatnonzero(u > c)[-1]], 0)


def _descend(slope: object, n: int, rounds: int = 5000) -> np.ndarray:
    w = np.ones(n) / n
    step = 0.5 / max(np.abs(slope(np.eye(n)[0])).max(), 1e-12)
    for _ in range(rounds):
        after = _simplex(w - step * slope(w))
        if np.abs(after - w).max() < 1e-12:
            break
        w = after
    return w


def held_on(orders: Iterable[tuple], steps: Iterable) -> dict:
    """Amounts after each step from dealt (step, instrument, signed amount)."""
    book: dict = {}
    out = {}
    todo = sorted(orders, key=lambda o: o[0])
    for step in steps:
        while todo and todo[0][0] <= step:
            _, who, amount = todo.pop(0)
            book[who] = book.get(who, 0.0) + amount
        out[step] = dict(book)
    return out


def previous_scores(signal: DataFrame) -> DataFrame:
    """signal with the date's predecessor's score, for native ranking before a fold."""
    order = Window.partitionBy(INSTRUMENT).orderBy(TIME)
    return signal.withColumn("previous_score", F.lag("score").over(order))
