"""Recursions along a series that no task holds whole.

A series is cut into blocks of ticks. A linear recursion is, for a block, a factor and an offset: blocks find
theirs alone, the few rows of a series' blocks are composed in order, and each block is gone through
again from its true start. A recursion with resets is guessed to start every block at rest; blocks whose start turns out to be
another are run again until no start changes. Autoregressions add up normal equations that blocks make
alone, with as many ticks before them as the order needs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Ticks of a block.
CHUNK = 65_536


def _schema(df: DataFrame, keys: list[str], *more: str) -> str:
    return ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), *more])


def _frame(keys: list[str], key: tuple, n: int, **columns) -> pd.DataFrame:
    return pd.DataFrame({**{k: pd.Series([v] * n, dtype=object) for k, v in zip(keys, key)}, **columns})


def _path(x: np.ndarray, gain: float, start: float) -> np.ndarray:
    """y_t = (1 - gain) * y_(t-1) + gain * x_t from `start` on."""
    return pd.Series(np.r_[start, x]).ewm(alpha=gain, adjust=False).mean().to_numpy()[1:]


def smoothed(df: DataFrame, keys: list[str], value: str | Sequence[str], gain: float | str, start: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(keys, tick, y): exponentially weighted means of `value` in the order of ticks; `start` names a column, one number a series,
    that stands before the first value (None: the first value itself). A `gain` that is a name is a column too, one number a series.
    Several values are gone through at once, and their means bear their names."""
    names = [value] if isinstance(value, str) else list(value)
    outs = ["y"] if isinstance(value, str) else names
    x, s, o = ([f"{c}{i}" for i in range(len(names))] for c in ("_x", "_s", "_o"))
    rate = (F.col(gain) if isinstance(gain, str) else F.lit(gain)).cast("double").alias("_g")
    given = [F.col(start).cast("double").alias("_s")] if start else []
    rows = df.select(*keys, "tick", rate, F.expr(f"tick div {chunk}").alias("_c"), *[F.col(v).cast("double").alias(a) for v, a in zip(names, x)], *given)
    by = [*keys, "_c"]
    first = rows.groupBy(*keys).agg(*[(F.first("_s") if start else F.min_by(a, "tick")).alias(b) for a, b in zip(x, s)])

    def response(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tick")
        g = float(pdf["_g"].iloc[0])
        return _frame(by, key, 1, factor=[(1 - g) ** len(pdf)], **{b: [float(_path(pdf[a].to_numpy(float), g, 0.0)[-1])] for a, b in zip(x, o)})

    def starts(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_c")
        out = {}
        for b, c in zip(s, o):
            at, out[b] = float(pdf[b].iloc[0]), []
            for f, v in zip(pdf["factor"], pdf[c]):
                out[b].append(at)
                at = f * at + v
        return _frame(keys, key, len(pdf), _c=pdf["_c"].to_numpy(), **out)

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tick")
        g = float(pdf["_g"].iloc[0])
        y = {name: _path(pdf[a].to_numpy(float), g, float(pdf[b].iloc[0])) for name, a, b in zip(outs, x, s)}
        return _frame(keys, key[:-1], len(pdf), tick=pdf["tick"].to_numpy(), **y)

    cells = rows.select(*by, "tick", "_g", *x)
    maps = cells.groupBy(*by).applyInPandas(response, _schema(rows, by, "factor double", *[f"{c} double" for c in o]))
    # one row a block: a series' composition is as many rows as it has blocks
    known = maps.join(first, keys).groupBy(*keys).applyInPandas(starts, _schema(rows, keys, "_c long", *[f"{c} double" for c in s]))
    return cells.join(known, by).groupBy(*by).applyInPandas(whole, _schema(rows, keys, "tick long", *[f"`{c}` double" for c in outs]))


def _cusum(x: np.ndarray, mean: float, sd: float, up: float, down: float) -> tuple[list[int], float, float]:
    """Places of alarms and the state after the last value; both sums are 0 after an alarm."""
    out = []
    for i, v in enumerate(x.tolist()):
        up, down = max(0.0, up + v - mean - 0.5 * sd), max(0.0, down + mean - v - 0.5 * sd)
        if max(up, down) > 5 * sd:
            out.append(i)
            up = down = 0.0
    return out, up, down


def cusum_alarms(df: DataFrame, keys: list[str], mean: str, sd: str, chunk: int = CHUNK) -> DataFrame:
    """(keys, tick) of a two-sided sum of `value` with slack sd / 2 and limit 5 sd that starts again after each alarm.

    mean and sd name columns, one number a series. Blocks are run from rest, then again from where the one before them ended,
    as long as that differs from what they were run from: a block forgets its start at its first alarm, or once both sums have been 0."""
    by = [*keys, "_c"]
    rows = df.select(*keys, "tick", "value", F.col(mean).cast("double").alias("_m"), F.col(sd).cast("double").alias("_sd"), F.expr(f"tick div {chunk}").alias("_c"))

    def ended(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, one = pdf.sort_values("tick"), pdf.iloc[0]
        _, up, down = _cusum(pdf["value"].to_numpy(float), one["_m"], one["_sd"], one["_u"], one["_d"])
        return _frame(by, key, 1, up=[float(up)], down=[float(down)], _u=[float(one["_u"])], _d=[float(one["_d"])])

    def alarmed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, one = pdf.sort_values("tick"), pdf.iloc[0]
        at, _, _ = _cusum(pdf["value"].to_numpy(float), one["_m"], one["_sd"], one["_u"], one["_d"])
        return _frame(keys, key[:-1], len(at), tick=pdf["tick"].to_numpy()[at])

    schema = _schema(rows, by, "up double", "down double", "_u double", "_d double")
    rest = rows.withColumn("_u", F.lit(0.0)).withColumn("_d", F.lit(0.0))
    state = stored(rest.groupBy(*by).applyInPandas(ended, schema))
    order = Window.partitionBy(*keys).orderBy("_c")
    while True:
        due = state.select("*", F.coalesce(F.lag("up").over(order), F.lit(0.0)).alias("_nu"), F.coalesce(F.lag("down").over(order), F.lit(0.0)).alias("_nd"))
        wrong = due.where("_nu <> _u OR _nd <> _d")
        if not wrong.limit(1).count():
            break
        again = rows.join(wrong.select(*by, F.col("_nu").alias("_u"), F.col("_nd").alias("_d")), by).groupBy(*by).applyInPandas(ended, schema)
        state = stored(due.where("_nu = _u AND _nd = _d").select(*state.columns).unionByName(again))
    return rows.join(state.select(*by, "_u", "_d"), by).groupBy(*by).applyInPandas(alarmed, _schema(rows, keys, "tick long"))


def _overlapping(df: DataFrame, keys: list[str], before: int, chunk: int) -> DataFrame:
    """Rows with their block `_c`; the last `before` ticks of a block also stand before the next one (`_own` false)."""
    c = F.expr(f"tick div {chunk}")
    late = F.col("tick") % chunk >= chunk - before
    blocks = F.when(late, F.array(F.struct(c.alias("_c"), F.lit(True).alias("_own")), F.struct((c + 1).alias("_c"), F.lit(False).alias("_own")))).otherwise(F.array(F.struct(c.alias("_c"), F.lit(True).alias("_own"))))
    return df.select("*", F.explode(blocks).alias("_b")).select("*", "_b._c", "_b._own").drop("_b")


def normal_equations(df: DataFrame, keys: list[str], orders: Sequence[int], ridge: float, chunk: int = CHUNK) -> DataFrame:
    """(keys, p, n, bias, weights) of ridge autoregressions of each order on standardized values, for series of
    3 * p + 10 values and more. Ticks run from 0 without gaps. Blocks add their parts of the normal equations; what is
    solved is one small system a series and order."""
    most = max(orders)
    if chunk < most:
        raise ValueError("a block is shorter than the order")
    stats = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("_m"), F.greatest(F.stddev_pop("value"), F.lit(1e-9)).alias("_s"))
    rows = _overlapping(df.join(stats, keys).select(*keys, "tick", "n", ((F.col("value") - F.col("_m")) / F.col("_s")).alias("z")), keys, most, chunk)
    by = [*keys, "_c"]

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tick")
        z, tick, own, n = pdf["z"].to_numpy(float), pdf["tick"].to_numpy(), pdf["_own"].to_numpy(bool), int(pdf["n"].iloc[0])
        out = []
        for p in orders:
            if n < 3 * p + 10:
                continue
            at = np.flatnonzero(own & (tick >= p))
            if len(at):
                lags = np.lib.stride_tricks.sliding_window_view(z, p)[at - p, ::-1]
                out.append((p, np.r_[(lags.T @ lags).ravel(), lags.T @ z[at]].tolist()))
        return _frame(keys, key[:-1], len(out), p=[o[0] for o in out], part=pd.Series([o[1] for o in out], dtype=object))

    parts = rows.groupBy(*by).applyInPandas(sums, _schema(df, keys, "p int", "part array<double>"))
    added = parts.select(*keys, "p", F.posexplode("part").alias("i", "v")).groupBy(*keys, "p", "i").agg(F.sum("v").alias("v"))
    system = added.groupBy(*keys, "p").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("g"))

    @F.pandas_udf("array<double>")
    def solve(p: pd.Series, n: pd.Series, g: pd.Series) -> pd.Series:
        def one(k: int, m: int, v) -> list[float]:
            v = np.asarray(v, float)
            return np.linalg.solve(v[: k * k].reshape(k, k) + ridge * (m - k) * np.eye(k), v[k * k :]).tolist()

        return pd.Series([one(int(k), int(m), v) for k, m, v in zip(p, n, g)], dtype=object)

    fit = system.join(stats, keys).withColumn("weights", solve("p", "n", "g"))
    total = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w)
    return fit.select(*keys, "p", "n", (F.col("_m") * (1 - total)).alias("bias"), "weights")


def squared_errors(df: DataFrame, models: DataFrame, keys: list[str], orders: Sequence[int], chunk: int = CHUNK) -> DataFrame:
    """(keys, p, mse): squared forecast errors of each model over the values of a series from the p-th on, over its number of values.
    Ticks run from 0 without gaps."""
    most = max(orders)
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    packed = models.groupBy(*keys).agg(F.collect_list(F.struct("p", "bias", "weights")).alias("models"))
    rows = _overlapping(df.select(*keys, "tick", "value"), keys, most, chunk).join(packed, keys)
    by = [*keys, "_c"]

    def errors(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tick")
        x, tick, own = pdf["value"].to_numpy(float), pdf["tick"].to_numpy(), pdf["_own"].to_numpy(bool)
        out = []
        for m in pdf["models"].iloc[0]:
            p = int(m["p"])
            at = np.flatnonzero(own & (tick >= p))
            if len(at):
                said = m["bias"] + np.lib.stride_tricks.sliding_window_view(x, p)[at - p, ::-1] @ np.asarray(m["weights"], float)
                out.append((p, float(((x[at] - said) ** 2).sum())))
            else:
                out.append((p, 0.0))
        return _frame(keys, key[:-1], len(out), p=[o[0] for o in out], sse=[o[1] for o in out])

    sse = rows.groupBy(*by).applyInPandas(errors, _schema(df, keys, "p int", "sse double")).groupBy(*keys, "p").agg(F.sum("sse").alias("_e"))
    return sse.join(n, keys).select(*keys, "p", (F.col("_e") / F.greatest("_n", F.lit(1))).alias("mse"))


def best_order(train: DataFrame, keys: list[str], orders: Sequence[int], ridge: float, usual: int, chunk: int = CHUNK) -> DataFrame:
    """(keys, p): the order whose fit on the first four fifths forecasts the last fifth best (ties: the smallest), `usual`
    where no order can be fitted."""
    n = train.groupBy(*keys).agg(F.expr("count(*) * 4 div 5").alias("_cut"))
    cut = train.join(n, keys)
    head = cut.where("tick < _cut").drop("_cut")
    tail = cut.where("tick >= _cut").withColumn("tick", F.col("tick") - F.col("_cut")).drop("_cut")
    scored = squared_errors(tail, normal_equations(head, keys, orders, ridge, chunk), keys, orders, chunk)
    best = scored.groupBy(*keys).agg(F.min(F.struct("mse", "p"))["p"].alias("p"))
    return n.join(best, keys, "left").select(*keys, F.coalesce("p", F.lit(usual)).alias("p"))


def forecast_errors(df: DataFrame, models: DataFrame, keys: list[str], on: list[str], longest: int, chunk: int = CHUNK) -> DataFrame:
    """(keys, tick, e, variance): |value - forecast| by a series' model, 0 for the first p ticks, and the population variance of its last
    `width` ones, 0 for the first `width` ticks. models: (on, p, bias, weights, width), `on` among the keys; p + width is
    `longest` at most. Series without a model give no rows. Ticks run from 0 without gaps. A block has the ticks
    before it that it needs; a model goes to a block once, not with each of its rows."""
    if chunk < longest:
        raise ValueError("a block is shorter than the order and the width")
    by = [*keys, "_c"]
    rows = _overlapping(df.select(*keys, "tick", F.col("value").cast("double").alias("value")), keys, longest, chunk)
    blocks = df.select(*keys, F.expr(f"tick div {chunk}").alias("_c")).distinct().join(models.select(*on, "p", "bias", "weights", "width"), on)
    named = [f"_k{i}" for i in range(len(by))]
    blocks = blocks.select(*[F.col(k).alias(n) for k, n in zip(by, named)], "p", "bias", "weights", "width")

    def errors(key: tuple, pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(known):
            return _frame(keys, key[:-1], 0, tick=[], e=[], variance=[])
        pdf, m = pdf.sort_values("tick"), known.iloc[0]
        x, tick, own, p, width = pdf["value"].to_numpy(float), pdf["tick"].to_numpy(), pdf["_own"].to_numpy(bool), int(m["p"]), int(m["width"])
        e, v = np.zeros(len(x)), np.zeros(len(x))
        if len(x) > p:
            e[p:] = np.abs(x[p:] - (m["bias"] + np.lib.stride_tricks.sliding_window_view(x, p)[:-1, ::-1] @ np.asarray(m["weights"], float)))
        due = np.flatnonzero(own & (tick >= width))
        for k in range(0, len(due), 4096):
            at = due[k : k + 4096]
            v[at] = np.lib.stride_tricks.sliding_window_view(e, width)[at - width + 1].var(axis=1)
        return _frame(keys, key[:-1], int(own.sum()), tick=tick[own], e=e[own], variance=v[own])

    return rows.groupBy(*by).cogroup(blocks.groupBy(*named)).applyInPandas(errors, _schema(df, keys, "tick long", "e double", "variance double"))
