"""Universe filters, top-k selection, weights, sizing and reconciliation.

Top-k per date is ``row_number() <= k``: the optimizer prunes to k rows per task
before the shuffle, so a date of any width costs k rows per task.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions import windows as W
from barweave.functions.mathx import clip, lookup, round_half_up
from barweave.functions.ranks import exact_quantiles, value_positions
from barweave.operators import features as T
from barweave.session import cut_lineage, written
from barweave.sources.bars import calendar

def by_date():
    return Window.partitionBy("date")


def top_n(df: DataFrame, n: int, order: list[Column], keys=("date",), out: str = "rn") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= n)


def recent_rows(bars: DataFrame, n: int) -> DataFrame:
    return top_n(bars, n, [F.col("date").desc()], ("ticker",), "_rn").drop("_rn")


def liquidity(bars: DataFrame, n: int = 20) -> DataFrame:
    """Mean volume and dollar volume over each ticker's last n rows."""
    return recent_rows(bars, n).groupBy("ticker").agg(
        F.avg("volume").alias("adv"), F.avg(F.col("volume") * F.col("close")).alias("dollar_adv"), F.count("volume").alias("n_vol")
    )


def liquid_universe(bars: DataFrame, n=20, min_adv=0.0, min_dollar=0.0) -> DataFrame:
    return liquidity(bars, n).where((F.col("n_vol") > 0) & (F.col("adv") >= min_adv) & (F.col("dollar_adv") >= min_dollar))


def top_dollar_adv(bars: DataFrame, k: int, n: int = 20) -> DataFrame:
    return liquidity(bars, n).orderBy(F.desc("dollar_adv"), "ticker").limit(k)


def adv_with_fallback(names: DataFrame, cache: DataFrame, computed: DataFrame, default: float) -> DataFrame:
    j = names.join(cache.select("ticker", F.col("adv").alias("_c")), "ticker", "left")
    j = j.join(computed.select("ticker", F.col("adv").alias("_p")), "ticker", "left")
    tag = F.when(F.col("_c").isNotNull(), "cache").when(F.col("_p").isNotNull(), "computed").otherwise("default")
    return j.select("ticker", F.coalesce("_c", "_p", F.lit(default)).alias("adv"), tag.alias("source"))


def top_k_weights(scored: DataFrame, x: str, k: int | Column) -> DataFrame:
    """Top k by score (ties by ticker), shifted to non-negative and normalised;
    equal weights when everything is zero.  A column ``k`` varies by row."""
    ok = scored.where(F.col(x).isNotNull())
    rn = F.row_number().over(by_date().orderBy(F.desc(x), F.col("ticker")))
    picked = ok.withColumn("rn", rn).where(F.col("rn") <= k)
    alloc = F.col(x) - F.least(F.min(x).over(by_date()), F.lit(0.0))
    picked = picked.withColumn("_a", alloc)
    total = F.sum("_a").over(by_date())
    w = F.when(total > 0, F.col("_a") / F.nullif(total, F.lit(0.0))).otherwise(1.0 / F.count(F.lit(1)).over(by_date()))
    return picked.withColumn("weight", w).drop("_a")


def regime_top_k(scored: DataFrame, x: str, normal_k=10, crisis_k=4, normal_exp=1.0, crisis_exp=0.25) -> DataFrame:
    """Regime-dependent k and exposure.  The larger k prunes first."""
    crisis = F.col("regime") == "Crisis"
    pruned = top_n(scored.where(F.col(x).isNotNull()), max(normal_k, crisis_k), [F.desc(x), F.col("ticker")], out="_rn").drop("_rn")
    w = top_k_weights(pruned, x, F.when(crisis, crisis_k).otherwise(normal_k))
    exp = F.when(crisis, min(max(crisis_exp, 0.0), 1.0)).otherwise(min(max(normal_exp, 0.0), 1.0))
    return w.withColumn("exposure", exp).withColumn("weight", F.col("weight") * F.col("exposure"))


def rank_weights(scored: DataFrame, x: str, long_only: bool = False) -> DataFrame:
    """Centred percentile ranks with unit gross weight.  Totals per date come from
    an aggregate, not a window over the date."""
    scored = written(scored, "scores")  # read by the ranking and the result
    pos = value_positions(scored, ["date"], x)  # a row per value: ranks and totals come from it, with its copies
    rank = F.col("_before") + (F.col("_c") + 1) / 2.0
    # a lone value, and a missing one, stands in the middle
    pct = F.coalesce(F.when(F.col("_n") > 1, (rank - 1.0) / F.nullif(F.col("_n") - 1.0, F.lit(0.0))), F.lit(0.5))
    raw = lambda p: F.greatest(p - 0.5, F.lit(0.0)) if long_only else p - 0.5
    pos = pos.select("date", x, "_c", "_n", pct.alias("rank_pct"))
    g = pos.groupBy("date").agg(F.max("_n").alias("_n"), F.sum(F.abs(raw(F.col("rank_pct"))) * F.col("_c")).alias("_g"))
    r = scored.join(pos.select("date", x, "rank_pct"), ["date", x], "left").fillna(0.5, subset=["rank_pct"])
    r = r.join(F.broadcast(g), "date", "left").fillna(0, subset=["_n", "_g"]).withColumn("weight_raw", raw(F.col("rank_pct")))
    flat = F.when(F.col(x).isNotNull(), 1.0 / F.col("_n")).otherwise(0.0) if long_only else F.lit(0.0)
    return r.withColumn("weight", F.when(F.col("_g") > 1e-12, F.col("weight_raw") / F.nullif(F.col("_g"), F.lit(0.0))).otherwise(flat)).drop("_n", "_g")


def high_conviction(ranked: DataFrame, rank: str, score: str, threshold=0.6, k=5) -> DataFrame:
    """Names above the rank threshold, or everybody on dates where none passes;
    top k weighted by rank."""
    valid = written(ranked.where(F.col(rank).isNotNull()), "ranked")  # read twice
    any_pass = valid.groupBy("date").agg(F.max(F.col(rank) > threshold).alias("_any"))
    pool = valid.join(F.broadcast(any_pass), "date").where(~F.col("_any") | (F.col(rank) > threshold))
    top = top_n(pool, k, [F.desc(rank), F.desc(score), F.col("ticker")])
    w = F.greatest(F.col(rank), F.lit(0.0))
    tot = F.sum(w).over(by_date())
    return top.withColumn("weight", F.when(tot > 1e-12, w / F.nullif(tot, F.lit(0.0))).otherwise(1.0 / F.count(F.lit(1)).over(by_date()))).drop("_any")


# Fixed values: |score| bands to holding days, and the fallback by signal.
HOLD_BANDS = ((0.5, 10), (0.3, 5))
HOLD_BY_SIGNAL = {"Bullish": 5, "Bearish": 3}
HOLD_DEFAULT = 5


def holding_days(score: Column, regime: Column, signal: Column, bands=HOLD_BANDS, default=HOLD_DEFAULT, crisis_cap=3, bear_cap=3) -> Column:
    h = None
    for lo, days in sorted(bands, reverse=True):
        h = F.when(F.abs(score) >= lo, days) if h is None else h.when(F.abs(score) >= lo, days)
    for name, days in HOLD_BY_SIGNAL.items():
        h = h.when(signal == name, days)
    h = h.otherwise(default)
    return F.when(regime == "Crisis", F.least(h, F.lit(crisis_cap))).when(regime == "Bear", F.least(h, F.lit(max(1, bear_cap)))).otherwise(h)


def ranked_candidates(signals: DataFrame, counts: DataFrame, min_strength=0.3, max_longs=5, max_shorts=5, penalty=0.002) -> DataFrame:
    """Per date: strength filter, best |score| per side up to its slots, holding
    days, then order by |score| less a penalty for names traded often before.
    ``counts`` holds prior trade counts per (ticker, date)."""
    s = signals.withColumn("adj", round_half_up(F.col("score"), 4))
    directional = F.col("signal").isin("Bullish", "Bearish") & (F.abs("score") >= 1e-9)
    s = s.where(directional | (F.abs("score") >= min_strength)).where(F.col("signal") != "Neutral")
    strong = [F.desc(F.abs("adj")), F.col("ticker")]
    # the larger side limit prunes before the shuffle, the exact one after it
    sided = top_n(s, max(max_longs, max_shorts), strong, ("date", "signal"), "side_rn")
    sided = sided.where(F.col("side_rn") <= F.when(F.col("signal") == "Bullish", max_longs).otherwise(max_shorts))
    j = sided.join(counts, ["ticker", "date"], "left").withColumn("prior", F.coalesce("n_prior", F.lit(0)))
    j = j.withColumn("hold", holding_days(F.col("adj"), F.col("regime"), F.col("signal")))
    # the penalty is multiplied as a decimal: equal ranks stay equal and fall to the ticker
    order = F.abs("adj") - (F.lit(Decimal(str(penalty))) * F.col("prior")).cast("double")
    return j.withColumn("priority", F.row_number().over(by_date().orderBy(order.desc(), F.col("ticker"))))


def prior_counts(trade_log: DataFrame) -> DataFrame:
    """Trades of a ticker entered before each date, from daily counts."""
    daily = trade_log.groupBy("ticker", F.col("entry_date").alias("date")).agg(F.count(F.lit(1)).alias("_n"))
    w = W.expanding()
    return daily.select("ticker", "date", (F.sum("_n").over(w) - F.col("_n")).alias("n_prior"))


def longs_and_shorts(scored: DataFrame, x: str, longs=5, shorts=5, min_strength=0.0) -> DataFrame:
    """Top names long, bottom names short; a name already long is not shorted and
    dates with fewer names than short slots have no shorts."""
    ok = scored.where(F.abs(x) >= min_strength)
    n = ok.groupBy("date").agg(F.count(F.lit(1)).alias("_n"))
    top = top_n(ok, longs, [F.desc(x), F.col("ticker")], out="_rl").select("ticker", "date", x, F.col("_rl").alias("rn"), F.lit("long").alias("side"))
    bottom = top_n(ok, shorts, [F.asc(x), F.col("ticker").desc()], out="_rs").join(F.broadcast(n.where(F.col("_n") >= shorts)), "date", "left_semi")
    bottom = bottom.select("ticker", "date", x, F.col("_rs").alias("rn"), F.lit("short").alias("side"))
    return top.unionByName(bottom.join(top.select("ticker", "date"), ["ticker", "date"], "left_anti"))


def daily_selection(scored: DataFrame, x: str, mult=0.8, longs=5, shorts=5, max_positions=8) -> DataFrame:
    """Crisis dates keep only the top 5 %; then |score| beyond ``mult`` deviations of
    what is left, heads of both sides, re-ranked by |score|."""
    q = exact_quantiles(scored.where("regime = 'Crisis'"), ["date"], x, {"_q": 0.95})
    s = scored.join(F.broadcast(q), "date", "left").where(F.col("_q").isNull() | (F.col(x) > F.col("_q")))
    sd = s.groupBy("date").agg(F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("_sd"))
    s = s.join(F.broadcast(sd), "date").where(F.abs(x) > mult * F.col("_sd"))
    up = top_n(s.where(F.col(x) > 0), longs, [F.desc(x), F.col("ticker")], out="_r")
    down = top_n(s.where(F.col(x) < 0), shorts, [F.asc(x), F.col("ticker")], out="_r")
    both = up.unionByName(down).drop("_r", "_q", "_sd")
    return top_n(both, max_positions, [F.desc(F.abs(x)), F.col("ticker")]).withColumn("signal", F.when(F.col(x) > 0, 1).otherwise(-1))


def target_weights(scored: DataFrame, x: str, mult=0.8, longs=10, shorts=5, cap=0.12, short_cap=None, max_net=0.6, max_gross=1.0) -> DataFrame:
    """Equal-magnitude book per date with single-name, net and gross caps."""
    sd = scored.groupBy("date").agg(F.stddev_pop(x).alias("_sd"))
    s = scored.join(F.broadcast(sd), "date")
    s = s.where(F.abs(x) > F.coalesce(F.when(F.col("_sd") > 0, mult * F.col("_sd")), F.lit(0.0)))
    up = top_n(s.where(F.col(x) > 0), longs, [F.desc(x), F.col("ticker")], out="_r")
    down = top_n(s.where(F.col(x) < 0), shorts, [F.asc(x), F.col("ticker")], out="_r")
    t = up.unionByName(down).drop("_r", "_sd")
    each = F.least(1.0 / F.count(F.lit(1)).over(by_date()), F.lit(cap))
    t = t.withColumn("_w", F.when(F.col(x) > 0, F.least(each, F.lit(cap))).otherwise(-F.least(each, F.lit(short_cap or cap))))
    long_sum, short_sum = F.sum(F.greatest("_w", F.lit(0.0))).over(by_date()), -F.sum(F.least("_w", F.lit(0.0))).over(by_date())
    t = t.withColumns({"_l": long_sum, "_s": short_sum})
    net = F.col("_l") - F.col("_s")
    sl = F.when((net > max_net) & (F.col("_l") > 1e-12), clip(W.safe_div(max_net + F.col("_s"), F.nullif(F.col("_l"), F.lit(0.0))), 0.0, 1.0)).otherwise(1.0)
    ss = F.when((net < -max_net) & (F.col("_s") > 1e-12), clip(W.safe_div(F.col("_l") + max_net, F.nullif(F.col("_s"), F.lit(0.0))), 0.0, 1.0)).otherwise(1.0)
    t = t.withColumn("_w", F.col("_w") * F.when(F.col("_w") > 0, sl).otherwise(ss))
    gross = F.sum(F.abs("_w")).over(by_date())
    return t.withColumn("target_weight", F.when(gross > max_gross, F.col("_w") * max_gross / gross).otherwise(F.col("_w"))).drop("_w", "_l", "_s")


def reconcile(target: DataFrame, current: DataFrame, keys=("ticker", "date")) -> DataFrame:
    """open / close / hold per key; a side flip both closes and opens."""
    t = target.select(*keys, F.signum("target_weight").cast("int").alias("t")).where("t <> 0")
    c = current.select(*keys, F.signum("current_weight").cast("int").alias("c")).where("c <> 0")
    j = t.join(c, list(keys), "full_outer")
    acts = (
        F.when(F.col("c").isNull(), F.array(F.lit("open")))
        .when(F.col("t").isNull(), F.array(F.lit("close")))
        .when(F.col("t") == F.col("c"), F.array(F.lit("hold")))
        .otherwise(F.array(F.lit("close"), F.lit("open")))
    )
    return j.select(*keys, F.explode(acts).alias("action"))


def carried_book(target: DataFrame, cal: DataFrame) -> DataFrame:
    """The book of each date as the current holdings of the next calendar date."""
    t = target.join(F.broadcast(cal), "date").withColumn("idx", F.col("idx") + 1)
    return t.drop("date").join(F.broadcast(cal), "idx").select("ticker", "date", F.col("target_weight").alias("current_weight"))


def planned_orders(target: DataFrame, actions: DataFrame, equity: float, min_notional=100.0) -> DataFrame:
    opens = actions.where("action = 'open'").select("ticker", "date")
    j = target.join(opens, ["ticker", "date"]).withColumn("notional", F.abs(F.col("target_weight") * equity))
    j = j.where(F.col("notional") >= min_notional)
    return j.withColumn("side", F.when(F.col("target_weight") > 0, "buy").otherwise("sell")).withColumn("total", F.sum("notional").over(by_date()))


def greedy_limits(book: DataFrame, max_positions=10, cap=0.12, max_beta=1.0, max_sector=0.3, max_single=None, max_adv_frac=None, equity=1e6) -> DataFrame:
    """Greedy subset of each date's target book in score order under beta, sector,
    single-name and liquidity limits, with the reason of every skip.

    The book holds at most the long plus short slots of a date (an earlier top-k),
    so a group is bounded by those parameters.
    """
    w_mag = min(1.0 / max(1, max_positions), cap)

    def walk(score, beta_of, sector, adv, close):
        beta, used, kept, reasons = 0.0, {}, 0, []
        for s, b, sec, a, px in zip(score, beta_of, sector, adv, close):
            w = w_mag * np.sign(s)
            if kept >= max_positions:
                r = "slots_full"
            elif max_single is not None and abs(w) > max_single:
                r = "max_single_name"
            elif max_beta is not None and beta + w * b > max_beta:
                r = "max_beta"
            elif max_sector is not None and used.get(sec, 0.0) + abs(w) > max_sector + 1e-12:
                r = "max_sector_exposure"
            elif max_adv_frac is not None and abs(w) * equity / px > max_adv_frac * a:
                r = "liquidity_adv"
            else:
                r, kept, beta = "kept", kept + 1, beta + w * b
                used[sec] = used.get(sec, 0.0) + abs(w)
            reasons.append(r)
        each = min(1.0 / max(1, kept), cap)
        return [{"reason": r, "weight": float(each * np.sign(s)) if r == "kept" else 0.0} for s, r in zip(score, reasons)]

    @F.pandas_udf("array<struct<reason:string,weight:double>>")
    def decide(score: pd.Series, beta: pd.Series, sector: pd.Series, adv: pd.Series, close: pd.Series) -> pd.Series:
        return pd.Series([walk(*day) for day in zip(score, beta, sector, adv, close)])

    day = _ordered_book(book, F.col("score"), ["beta", "sector", "adv", "close"])
    out = day.withColumn("_d", decide("b.score", "b.beta", "b.sector", "b.adv", "b.close"))
    return out.select("date", F.explode(F.arrays_zip("b.ticker", "b.score", "_d")).alias("x")).select(
        F.col("x.ticker"), "date", F.col("x.score"), F.col("x._d.reason").alias("reason"), F.col("x._d.weight").alias("weight"))


def orderless_sum(values: list[float]) -> float:
    """The sum rounded once, so that no order of the values changes it; a plain sum where they are not finite."""
    try:
        return math.fsum(values)
    except (OverflowError, ValueError):
        return sum(values)


def walk_limits(names, scores, betas, sectors, advs, closes, holdings, limits: dict) -> list[tuple[str, float, int]]:
    """Decisions on one date's candidates, best first: (reason, weight, round) for each.

    ``holdings`` are the opening book's (ticker, weight, beta, sector); a candidate
    moves the book by its weight less what is held of it.  Limits, None where off: ``max_positions``,
    ``cap`` (largest weight), ``sizing``, ``max_beta``, ``max_sector``, ``sector_caps``, ``max_single``,
    ``max_adv_frac`` and ``equity``.  What is left at the end shares the weight equally, so a
    name whose larger share breaks its part of daily volume goes and the rest is sized again;
    every such round drops a name, so there are at most as many rounds as names (``round`` tells the one).
    """
    held: dict = {}
    sizes: dict = {}
    for ticker, w, _, sec in holdings:
        held[ticker] = held.get(ticker, 0.0) + w
        sizes.setdefault(sec, []).append(abs(w))
    # equal weights and clipped betas meet a limit exactly, so the last bit of these sums decides: it must not follow the order of the holdings
    beta, used = orderless_sum([w * b for _, w, b, _ in holdings]), {sec: orderless_sum(x) for sec, x in sizes.items()}
    sizing = limits.get("sizing") or 1.0
    size = min(1.0 / max(1, limits["max_positions"]), limits["cap"]) * (sizing if sizing > 0 else 1.0)
    part, equity = limits.get("max_adv_frac"), limits["equity"]
    too_much = lambda w, i: part is not None and not abs(w) * equity / closes[i] <= part * advs[i]
    reasons, kept = [], []
    for i, (ticker, score) in enumerate(zip(names, scores)):
        sign = 1.0 if score > 0 else -1.0 if score < 0 else 0.0
        w = sign * size
        delta = w - held.get(ticker, 0.0)
        cap = limits.get("sector_caps", {}).get(sectors[i], limits.get("max_sector"))
        if sign == 0.0:
            reason = "no_side"
        elif len(kept) >= limits["max_positions"]:
            reason = "slots_full"
        elif limits.get("max_single") is not None and abs(w) > limits["max_single"]:
            reason = "max_single_name"
        elif limits.get("max_beta") is not None and beta + delta * betas[i] > limits["max_beta"]:
            reason = "max_beta"
        elif cap is not None and cap > 0 and used.get(sectors[i], 0.0) + abs(delta) > cap:
            reason = "max_sector_exposure"
        elif too_much(w, i):
            reason = "liquidity_adv"
        else:
            reason = "kept"
            kept.append(i)
            beta += delta * betas[i]
            used[sectors[i]] = used.get(sectors[i], 0.0) + abs(delta)
            held[ticker] = w
        reasons.append(reason)
    weights, rounds, turn = [0.0] * len(reasons), [0] * len(reasons), 0
    while kept:
        turn += 1
        each = min(1.0 / len(kept), limits["cap"]) * (sizing if sizing > 0 else 1.0)
        over = {i for i in kept if too_much(each, i)}
        for i in over:
            reasons[i], rounds[i] = "liquidity_adv_sizing", turn
        kept = [i for i in kept if i not in over]
        if not over:
            for i in kept:
                weights[i] = each if scores[i] > 0 else -each
            break
    return list(zip(reasons, weights, rounds))


LIMITS = {"max_positions": 10, "cap": 0.12, "sizing": 1.0, "max_beta": 1.0, "max_sector": 0.3, "sector_caps": {}, "max_single": None, "max_adv_frac": None, "equity": 1e6}


def limits_on_holdings(book: DataFrame, holdings: DataFrame, **limits) -> DataFrame:
    """ticker, date, score, reason, weight and round of each date's target book under ``LIMITS``
    (others by name), against what is held that day.

    ``book`` has ticker, date, score, beta, sector, adv and close, and is cut to a date's slots;
    ``holdings`` has ticker, date, weight, beta and sector.  Dates are decided on their own; both sides
    of a date are bounded by its slots.  A date without holdings starts from an empty book.
    """
    on = LIMITS | limits
    opening = holdings.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("ticker", "weight", "beta", "sector"))).alias("_held"))
    day = _ordered_book(book, F.col("score"), ["beta", "sector", "adv", "close"]).join(opening, "date", "left")
    held = F.coalesce("_held", F.array().cast(opening.schema["_held"].dataType))

    @F.pandas_udf("array<struct<reason:string,weight:double,round:int>>")
    def decide(b: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for rows, opened in zip(b, h):
            columns = [[r[c] for r in rows] for c in ("ticker", "score", "beta", "sector", "adv", "close")]
            out.append([{"reason": r, "weight": w, "round": n} for r, w, n in walk_limits(*columns, [tuple(x[c] for c in ("ticker", "weight", "beta", "sector")) for x in opened], on)])
        return pd.Series(out)

    out = day.withColumn("_d", decide("b", held))
    return out.select("date", F.explode(F.arrays_zip("b.ticker", "b.score", "_d")).alias("x")).select(F.col("x.ticker"), "date", F.col("x.score"), "x._d.*")


def limits_carried(book: DataFrame, account: str = "account", **limits) -> DataFrame:
    """``limits_on_holdings`` where each date's decided weights are the next date's holdings.

    Path-dependent, so an account's dates go one by one; its rows are its calendar times its
    slots, and accounts are apart.  A held name that is not in the new book counts as sold
    after the decisions: it is in the opening book of its date and gone on the next.
    """
    on = LIMITS | limits
    schema = f"{account} {book.schema[account].dataType.simpleString()}, ticker {book.schema['ticker'].dataType.simpleString()}, date date, score double, reason string, weight double, round int"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["date", "score", "ticker"], ascending=[True, False, True])
        held, parts = [], []
        for _, day in rows.groupby("date", sort=True):
            columns = [day[c].tolist() for c in ("ticker", "score", "beta", "sector", "adv", "close")]
            found = walk_limits(*columns, held, on)
            parts.append(day[[account, "ticker", "date", "score"]].assign(reason=[f[0] for f in found], weight=[f[1] for f in found], round=[f[2] for f in found]))
            held = sorted((t, f[1], b, s) for t, f, b, s in zip(columns[0], found, columns[2], columns[3]) if f[1])
        return pd.concat(parts)

    return book.groupBy(account).applyInPandas(run, schema)


def _ordered_book(book: DataFrame, order: Column, cols: list[str]) -> DataFrame:
    """One row per date with the book as an array, best first, ties by ticker.  Only
    for books already cut to their slots."""
    entry = F.struct((-order).alias("_o"), "ticker", "score", *cols)
    return book.groupBy("date").agg(F.array_sort(F.collect_list(entry)).alias("b"))


def limit_flags(book: DataFrame, max_single: float, max_adv_frac: float, equity: float) -> DataFrame:
    """The limits that need no order: single-name weight and share of ADV."""
    shares = F.abs("target_weight") * equity / F.col("close")
    return book.withColumns({
        "over_single": F.abs("target_weight") > max_single, "over_adv": shares > max_adv_frac * F.col("adv")})


def prune_correlated(cands: DataFrame, limit: float = 0.7) -> DataFrame:
    """Keep the next best name unless its |correlation| with a kept one is above the
    limit.  ``cands`` carries each name's recent dates and returns (``days``,
    ``rets``); the names of a date are bounded by the candidate slots."""

    def walk(days, rets):
        common = days[0]
        for d in days[1:]:
            common = np.intersect1d(common, d, assume_unique=True)
        n, out, kept = len(days), [], []
        corr = np.zeros((n, n))
        if len(common) > 1:
            m = np.stack([np.asarray(r)[np.isin(d, common)] for d, r in zip(days, rets)])
            with np.errstate(invalid="ignore", divide="ignore"):
                corr = np.nan_to_num(np.abs(np.corrcoef(m))).reshape(n, n)
        for i in range(n):
            worst = max((corr[i, k] for k in kept), default=0.0)
            keep = worst <= limit
            if keep:
                kept.append(i)
            out.append({"max_corr": float(worst), "kept": bool(keep)})
        return out

    @F.pandas_udf("array<struct<max_corr:double,kept:boolean>>")
    def decide(days: pd.Series, rets: pd.Series) -> pd.Series:
        return pd.Series([walk(list(d), list(r)) for d, r in zip(days, rets)])

    day = _ordered_book(cands, F.abs("score"), ["days", "rets"])
    out = day.withColumn("_d", decide("b.days", "b.rets"))
    return out.select("date", F.explode(F.arrays_zip("b.ticker", "b.score", "_d")).alias("x")).select(
        F.col("x.ticker"), "date", F.col("x.score"), F.col("x._d.max_corr").alias("max_corr"), F.col("x._d.kept").alias("kept"))


def return_history(rets: DataFrame, cands: DataFrame, n: int = 60) -> DataFrame:
    """``cands`` with the day numbers and returns of their last n bars, oldest first.

    A date's candidates are its slots, so all of them are bounded by the calendar and go to
    the bars, which stay where they are: a bar moves only if it lies in the last n of a candidate.
    """
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    bars = rets.select("ticker", "date", day.alias("_day"), "r", F.row_number().over(W.by_key()).alias("_at"))
    spots = bars.select("ticker", "date", "_at").join(F.broadcast(cands), ["ticker", "date"]).withColumnRenamed("_at", "_to")
    spots = cut_lineage(spots)
    last = bars.drop("date").join(F.broadcast(spots), "ticker").where(F.col("_at").between(F.col("_to") - n + 1, F.col("_to")) & F.col("r").isNotNull())
    got = last.groupBy("ticker", "date").agg(F.array_sort(F.collect_list(F.struct("_day", "r"))).alias("_h"))
    none = F.array().cast(got.schema["_h"].dataType)
    out = spots.drop("_to").join(got, ["ticker", "date"], "left").withColumn("_h", F.coalesce("_h", none))
    return out.withColumns({"days": F.col("_h._day"), "rets": F.col("_h.r")}).drop("_h")


def drawdown_multiplier(equity: DataFrame, key="acct") -> DataFrame:
    """Sizing multiplier 1 / .8 / .6 / .4 by drawdown from the running peak."""
    peak = F.max("equity").over(W.expanding(key))
    out = equity.withColumn("drawdown", F.when(peak > 0, (peak - F.col("equity")) / peak).otherwise(0.0))
    d = F.col("drawdown")
    return out.withColumn("multiplier", F.when(d < 0.05, 1.0).when(d < 0.10, 0.8).when(d < 0.15, 0.6).otherwise(0.4))


def vol_scaled_weights(book: DataFrame, w: str, vol: str, target=0.15, floor=0.05, cap=3.0) -> DataFrame:
    """Scale by target/vol and renormalise to unit gross; unknown vol is the target.
    The book is bounded by its slots per date."""
    v = F.coalesce(F.col(vol), F.lit(target))
    s = F.round(F.col(w) * T.vol_target_factor(v, target, floor, cap), 12)
    out = book.withColumn("_s", s)
    g = F.sum(F.abs("_s")).over(by_date())
    return out.withColumn("scaled_weight", F.when(g > 0, F.col("_s") / F.nullif(g, F.lit(0.0))).otherwise(0.0)).drop("_s")


def kill_switch(w: Column, vol: Column, threshold: float, cut: float) -> Column:
    return F.when(vol.isNotNull() & (vol > threshold), w * cut).otherwise(w)


def size_equal(equity: Column, slots: int, scale: Column, cap=0.25) -> Column:
    return F.greatest(F.least(F.greatest(equity / slots * scale, F.lit(0.0)), equity * cap), F.lit(0.0))


def size_vol(equity: Column, slots: int, scale: Column, vol: Column, cap=0.25, risk=0.15) -> Column:
    eq = F.greatest(equity / slots * scale, F.lit(0.0))
    by_vol = F.least(equity * max(risk, 0.0) / F.greatest(vol, F.lit(1e-3)), eq * 3.0)
    return F.greatest(F.least(F.when(vol.isNull() | (vol <= 1e-8), eq).otherwise(by_vol), equity * cap), F.lit(0.0))


def size_kelly(equity: Column, slots: int, scale: Column, p: Column, win: Column, loss: Column, fraction=0.5, cap=0.25) -> Column:
    b = F.when(loss > 0, W.safe_div(win, F.when(loss > 0, loss))).otherwise(2.0)
    full = F.when(b > 0, W.safe_div(p * b - (1.0 - p), F.when(b > 0, b))).otherwise(0.0)
    size = equity * clip(full, 0.0, 1.0) * fraction * scale
    return F.greatest(F.least(F.greatest(size, equity / slots * 0.5), equity * cap), F.lit(0.0))


def size_composed(equity: Column, weight: Column, vol_scale: Column, regime_scale: Column, cap=0.12, long_only=True, floor=None) -> Column:
    raw = equity * weight * vol_scale * regime_scale
    out = F.greatest(F.least(raw, equity * cap), -equity * cap)
    if floor is not None:
        out = F.when(F.abs(raw) < equity * floor, 0.0).otherwise(out)
    if long_only:
        out = F.when(weight < 0, 0.0).otherwise(out)
    return F.when(equity > 0, F.coalesce(out, F.lit(0.0))).otherwise(0.0)


def rolling_kelly(trade_log: DataFrame, n: int = 50, m: int = 20) -> DataFrame:
    """Win rate and mean win/loss of the last n closed trades as of each exit date.

    Only a date's own last n trades can ever be among the last n overall, so each
    date is first cut to n rows (pruned map-side); the ordered pass then holds at
    most n rows per calendar date.
    """
    order = ["order_id", "line", "part", "position_size", "ret"]
    last = top_n(trade_log, n, [F.desc(c) for c in order], ("exit_date",), "_rn")
    seq = last.select(F.lit(1).alias("acct"), "exit_date", "ret", *order[:-1], "_rn")
    w = Window.partitionBy("acct").orderBy("exit_date", F.desc("_rn")).rowsBetween(-(n - 1), 0)
    r = F.col("ret")
    k = seq.withColumns({
        "n_trades": F.count(r).over(w),
        "win_rate": F.avg(F.when(r > 0, 1.0).otherwise(0.0)).over(w),
        "avg_win": F.coalesce(F.avg(F.when(r > 0, r)).over(w), F.lit(0.02)),
        "avg_loss": F.coalesce(F.avg(F.when(r < 0, -r)).over(w), F.lit(0.015)),
    })
    return k.where((F.col("_rn") == 1) & (F.col("n_trades") >= m)).select(F.col("exit_date").alias("date"), "n_trades", "win_rate", "avg_win", "avg_loss")


def score_gates(scored: DataFrame, x: str, regime_sd: DataFrame, crisis_q=0.95, bear_q=0.7, n=60, mult=1.0, beta_cut=1.0) -> DataFrame:
    """Entry gates from the name's own recent scores: regime quantiles, dispersion
    (with the regime's global deviation for short histories) and low beta in Crisis."""
    quantiles = W.quantile_kernel(n, 1, crisis_q, bear_q)
    s = W.add_frames(scored, {
        "_cnt": lambda k: np.cumsum(~np.isnan(k[x])),
        ".q": lambda k: quantiles(k[x]),
        "_cq": lambda k: k[".q"][0],
        "_bq": lambda k: k[".q"][1],
        "_sd": ("std", x, n, 1),
    })
    s = s.join(F.broadcast(regime_sd.select("regime", F.col("score_std").alias("_rs"))), "regime", "left")
    sd = F.when(F.col("_cnt") >= 20, F.col("_sd")).otherwise(F.col("_rs"))
    enough = F.col("_cnt") >= max(20, n // 2)
    aggr = lookup(F.col("regime"), {"Sideways": 1.2}, 1.0)
    bad_q = F.when((F.col("regime") == "Crisis") & enough, F.col(x) < F.col("_cq")).when((F.col("regime") == "Bear") & enough, F.col(x) < F.col("_bq")).otherwise(F.lit(False))
    bad_b = (F.col("regime") == "Crisis") & (F.coalesce(F.col("beta"), F.lit(0.0)) > beta_cut)
    bad_s = F.coalesce((sd > 1e-12) & (F.abs(x) < mult * sd * aggr), F.lit(False))
    return s.withColumns({"quantile_ok": ~bad_q, "beta_ok": ~bad_b, "strength_ok": ~bad_s}).withColumn(
        "enter", F.col("quantile_ok") & F.col("beta_ok") & F.col("strength_ok")).drop("_cnt", "_cq", "_bq", "_sd", "_rs")


def exposure_flags(holdings: DataFrame, single=0.25, top2=0.5, concentrated=0.6, sector="ASIA") -> DataFrame:
    """Per date: largest one and two weights, sector share of names, weighted signal
    and beta, and an array of raised flags.  Only the two largest names of a date
    are ordered."""
    tot = holdings.groupBy("date").agg(
        F.sum("value").alias("_v"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("sector") == sector).alias("_sec"),
        F.sum(F.col("value") * F.col("score")).alias("_sig"), F.sum(F.col("value") * (1.0 + F.col("score"))).alias("_beta"),
    )
    two = top_n(holdings.select("date", "ticker", "value"), 2, [F.desc("value"), F.col("ticker")]).groupBy("date").agg(
        F.max("value").alias("_1"), F.sum("value").alias("_2"), F.count(F.lit(1)).alias("_k"))
    j = tot.join(two, "date").select(
        "date", "n", (F.col("_1") / F.col("_v")).alias("top1"), (F.col("_2") / F.col("_v")).alias("top2"), "_k",
        (F.col("_sec") / F.col("n")).alias("sector_share"), (F.col("_sig") / F.col("_v")).alias("signal"), (F.col("_beta") / F.col("_v")).alias("beta"),
    )
    flags = F.array_compact(F.array(
        F.when(F.col("top1") > single, "single"),
        F.when((F.col("_k") >= 2) & (F.col("top2") > top2), "top2"),
        F.when(F.col("sector_share") >= concentrated, "sector"),
    ))
    return j.withColumn("flags", F.array_join(flags, ",")).drop("_k")


def last_n_dates(df: DataFrame, n: int) -> DataFrame:
    cal = calendar(df).orderBy(F.desc("date")).limit(n)
    return df.join(F.broadcast(cal.select("date")), "date", "left_semi")
