"""The endpoints: each takes frames and parameters and returns frames.

A frame of candles holds any number of symbols; results have a row or rows for
each. ``Market`` resamples trades to the candles that an endpoint wants, so a
user needs one table of trades, or candles of the finest timeframe.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import backtest as X
from .operators import bars as B
from .operators import bias as A
from .operators import candles as C
from .operators import confluence as N
from .operators import flow as W
from .operators import indicators as I
from .operators import outcomes as O
from .operators import profile as P
from .operators import sessions as S
from .operators import statistics as Z
from .operators import structure as T
from .functions.lineage import written_once
from .sources.market import TIMEFRAMES, crypto_only, normalize_timeframe, watchlist
from .sources.store import Store, day_index, first_day

#: Samples under which an endpoint says nothing about a symbol.
LEAST_BARS, LEAST_SMC_BARS, LEAST_DAYS, LEAST_WIDE_DAYS, LEAST_ALIGNED, LEAST_GRADED = 48, 248, 5, 10, 20, 50


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


@dataclass(frozen=True)
class Market:
    """Trades (symbol, ts, trade_id, price, qty, is_buyer_maker), cut to symbols. Of a
    ``store`` only the days that an endpoint needs are read; of other trades an
    index of their days is made once, and then as little of their times as may be.
    In place of trades there may be candles, of the ``finest`` timeframe there is."""

    trades: DataFrame | None
    store: Store | None = None
    candles: DataFrame | None = None
    finest: str = "1m"

    @classmethod
    def of(cls, store: Store) -> Market:
        return cls(store.trades, store)

    @classmethod
    def of_candles(cls, candles: DataFrame, timeframe: str) -> Market:
        """A market of candles (symbol, bar_ts, open, high, low, close, volume): what
        needs trades is refused, as are finer timeframes."""
        return cls(None, candles=candles.withColumn("ts", F.col("bar_ts")), finest=normalize_timeframe(timeframe))

    @property
    def source(self) -> DataFrame:
        return self.trades if self.candles is None else self.candles

    def _with(self, rows: DataFrame) -> Market:
        return Market(rows) if self.candles is None else Market(None, candles=rows, finest=self.finest)

    def _bars(self, rows: DataFrame, seconds: int) -> DataFrame:
        """Candles of so many seconds from rows of the source."""
        if self.candles is None:
            return B.resample(rows, seconds)
        least = TIMEFRAMES[self.finest]
        if seconds < least or seconds % least:
            raise ValueError(f"candles of {self.finest} give no candles of {seconds} seconds")
        return B.coarser(rows, seconds)

    def only(self, *symbols: str) -> Market:
        if not symbols:
            return self
        return Market.of(self.store.only(*symbols)) if self.store else self._with(self.source.where(F.col("symbol").isin(*symbols)))

    @functools.cached_property
    def index(self) -> DataFrame:
        return self.store.index if self.store else written_once(day_index(self.source), "days")

    def since(self, seconds: int, limit: int | None = None, days: int | None = None) -> DataFrame:
        """The trades of the days that hold the newest ``limit`` candles or ``days``."""
        day = first_day(self.index, seconds, limit, days)
        if self.store:
            return self.store.since(day)
        return self.source if day is None else self.source.where(F.col("ts") >= F.lit(day).cast("timestamp_ntz"))

    def until(self, time: str) -> Market:
        """The market as it stood at a time."""
        return self._with(self.source.where(F.col("ts") <= F.lit(time).cast("timestamp_ntz")))

    def bars(self, timeframe: str, limit: int | None = None, days: int | None = None, least: int = 0) -> DataFrame:
        """Candles, the newest ``limit`` or ``days`` of each symbol, of the symbols with ``least`` of them."""
        seconds = TIMEFRAMES[normalize_timeframe(timeframe)]
        asked = limit is not None or days is not None
        b = self._bars(self.since(seconds, limit if days is None else None, days) if asked else self.source, seconds)
        if days is not None:
            newest = b.groupBy("symbol").agg(F.max("bar_ts").alias("newest"))
            b = b.join(newest, "symbol").where(F.col("bar_ts") > F.col("newest") - F.make_dt_interval(F.lit(days))).drop("newest")
        b = b if limit is None else B.latest(b, limit)
        return T.enough(b, least) if least else b

    # -- structure, levels, profile, flow ---------------------------------------------------------

    def analyze_smc(self, timeframe: str = "1h", limit: int = 500) -> dict[str, DataFrame]:
        limit = clamp(limit, 1, 1000)
        swing, internal = T.LENGTHS[normalize_timeframe(timeframe)]
        s = T.of(B.indexed(T.long_enough(self.bars(timeframe, limit), swing)), short=True)
        return {
            "structures": T.newest(T.structures(s, swing, internal), s, ["ord"], 30), "order_blocks": T.order_blocks(s, swing, internal), "fair_value_gaps": T.gaps(s),
            "equal_levels": T.recent_equal_levels(s, swing), "swing_labels": T.swing_labels(s, swing), "fractals": T.fractals(s), "liquidity_sweeps": T.liquidity_sweeps(s, internal),
            "sweep_areas": T.sweep_areas(s, internal), "breaker_blocks": T.breaker_blocks(s, swing, internal), "candle_trends": T.candle_trends(s, internal), "range": T.trading_range(s, swing, internal),
        }

    def get_levels(self) -> DataFrame:
        return A.period_levels(self.bars("15m", 1000))

    def get_market_profile(self, timeframe: str = "15m", limit: int = 500, max_sessions: int = 10) -> dict[str, DataFrame]:
        b = P.recent_sessions(self.bars(timeframe, limit), normalize_timeframe(timeframe), max_sessions)
        return {"profiles": P.profiles(b, ["symbol", "sess"]), "rows": P.zones(b, ["symbol", "sess"])}

    def get_orderflow(self, timeframe: str = "5m", candles: int = 12) -> dict[str, DataFrame]:
        name = normalize_timeframe(timeframe)
        if name not in ("5m", "15m", "1h"):
            raise ValueError("footprints are built for 5m, 15m and 1h")
        if self.trades is None:
            raise ValueError("footprints are built from trades, and there are candles alone")
        seconds = TIMEFRAMES[name]
        most = clamp(candles, 1, 50)
        newest = self.index.groupBy("symbol").agg(F.max("last_ts").alias("newest"))
        since = F.window("newest", f"{seconds} seconds")["start"] - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit((most - 1) * seconds))
        t = self.since(seconds, days=most * seconds // 86_400 + 1).join(newest, "symbol").withColumn("since", since).where("ts >= since").drop("newest", "since")
        return {"levels": W.footprint_levels(t, seconds), "deltas": W.deltas(t, seconds), "large_trades": W.large_trades(t, seconds)}

    def scan_confluence(self) -> DataFrame:
        return N.grades(B.indexed(self.bars("1h", 300, least=LEAST_GRADED)), B.indexed(self.bars("4h", 300)))

    def scan_market(self, symbols: list[str] | str, only_actionable: bool = False) -> DataFrame:
        """``symbols``: a list, a watchlist's name, or symbols in one string."""
        names = watchlist(symbols) if isinstance(symbols, str) else list(dict.fromkeys(s.strip().upper() if s.isupper() else s.strip() for s in symbols))[:15]
        out = N.ranked(self.only(*names).scan_confluence(), names)
        return out.where("meets_threshold") if only_actionable else out

    def get_adr_ratio(self, days: int = 30) -> DataFrame:
        return I.adr_ratio(self.bars("1h", days=days))

    # -- statistics -------------------------------------------------------------------------------

    def compute_session_stats(self, days: int = 180) -> dict[str, DataFrame]:
        b = self.bars("1h", days=clamp(days, 1, 365), least=LEAST_BARS)
        r = S.session_ranges(b)
        return {
            "sessions": Z.range_summary(r), "sweeps": Z.sweep_summary(r, S.sweeps(b)), "ny_continuation": Z.continuation_summary(S.continuations(b)),
            "power_of_3": Z.power_of_three_summary(S.power_of_three(b), S.day_rows(b)), "day_of_week": Z.weekday_ranges(r), "adr": S.average_daily_range(b),
        }

    def compute_smc_stats(self) -> dict[str, DataFrame]:
        o = O.evaluated(B.indexed(self.bars("1h", 5000, least=LEAST_SMC_BARS)))
        return {"overall": O.statistics(o, "symbol"), "by_session": O.statistics(o, "symbol", "session")}

    def get_volatility(self, timeframe: str = "1h", atr_period: int = 14, adr_days: int = 14) -> dict[str, DataFrame]:
        name = normalize_timeframe(timeframe)
        b = B.indexed(self.bars(name, 300))
        return {"state": I.volatility_state(b, I.PER_YEAR[name]), "atr": I.atr(b, atr_period), "adr": I.adr_used(S.day_rows(self._bars(self.since(86_400, adr_days + 2), 3600)), adr_days)}

    def get_correlations(self, symbols: list[str], base: str, timeframe: str = "4h", limit: int = 180) -> dict[str, DataFrame]:
        names = list(dict.fromkeys([*symbols, base]))[: I.MOST_SYMBOLS]
        b = self.only(*names).bars(timeframe, limit)
        enough = lambda df: df.where(F.col("n") >= LEAST_ALIGNED)
        return {"matrix": enough(I.correlations(b)), "base": I.ranked_read(enough(I.base_read(b, base)))}

    def get_daily_bias(self, period: str = "D") -> dict[str, DataFrame]:
        e = A.bias_entries(self.bars("1h", 1000), period)
        return {"entries": e, "statistics": A.bias_statistics(e)}

    def get_ict_concepts(self, timeframe: str = "1h") -> dict[str, DataFrame]:
        b = self.bars(timeframe, 1000)
        return {"draw_on_liquidity": A.draw_on_liquidity(b), "phases": A.phases(b), "judas_swings": A.judas_swings(b), "session_bias": A.session_biases(b)}

    def compute_pdh_pdl_stats(self, days: int = 90) -> dict[str, DataFrame]:
        d = T.enough(S.prior_day_touch(self.bars("1h", days=clamp(days, 1, 180))), LEAST_WIDE_DAYS)
        return {"days": d, "sides": Z.prior_day_sides(d), "outcomes": Z.prior_day_outcomes(d), "day_of_week": Z.prior_day_weekdays(d)}

    def compute_ib_stats(self, days: int = 60, convention: str = "synthetic_ny") -> dict[str, DataFrame]:
        days = clamp(days, 1, 60)
        d = T.enough(S.initial_balance(self.bars("5m", days=days), self.bars("1h", days=days), convention), LEAST_WIDE_DAYS)
        return {"days": d, "breakouts": Z.break_summary(d), "extension": Z.balance_extension(d), "day_of_week": Z.balance_weekdays(d)}

    def compute_day_type_stats(self, days: int = 90) -> dict[str, DataFrame]:
        d = T.enough(S.day_types(self.bars("1h", days=clamp(days, 1, 180))), LEAST_DAYS)
        return {"days": d, "regimes": Z.regimes(d), "archetypes": Z.archetypes(d), "day_of_week": Z.archetype_weekdays(d)}

    def compute_session_extension_stats(self, days: int = 90) -> dict[str, DataFrame]:
        b = self.bars("1h", days=clamp(days, 1, 180))
        d, r = T.enough(S.day_summaries(b), LEAST_DAYS), S.session_ranges(b)
        return {
            "days": d, "session_ranges": Z.session_range_distributions(r), "extensions": Z.extension_grid(S.breakouts(b)),
            "daily_direction": Z.day_direction(d), "hod_lod": Z.extremes_of_sessions(Z.of_session_days(r, d)),
        }

    def get_session_forecast(self, days: int = 90, as_of: str | None = None) -> DataFrame:
        """A row per symbol about the session that comes next at ``as_of`` (its newest bar
        if none), from the ``days`` before it; no later trade counts."""
        market = self if as_of is None else self.until(as_of)
        return Z.forecast(market.bars("1h", days=clamp(days, 1, 180), least=LEAST_BARS), as_of)

    def get_price_action(self, timeframe: str = "1h", limit: int = 100) -> dict[str, DataFrame]:
        b = self.bars(timeframe, limit)
        return {"patterns": C.patterns(B.indexed(b)).orderBy("symbol", "bar_idx", "span", "ordinal"), "summary": B.recent_summary(b, 20)}

    def compute_peak_points_stats(self, days: int = 120) -> dict[str, DataFrame]:
        d = T.enough(S.peak_points(self.bars("1h", days=clamp(days, 1, 365))), LEAST_DAYS)
        return {"days": d, "matrix": Z.peak_matrix(d), "marginals": Z.peak_marginals(d)}

    def get_session_card(self, session: str, days: int = 120) -> dict[str, DataFrame | None]:
        name = session.strip().lower()
        if name not in S.SHORT:
            raise ValueError(f"unknown session {session!r}; known: {', '.join(S.SHORT)}")
        b = self.bars("1h", days=clamp(days, 1, 365))
        own = F.col("session") == name
        r = S.session_ranges(b).where(own)
        seen = Z.of_session_days(r, T.enough(S.day_summaries(b), LEAST_DAYS))
        return {
            "direction": Z.direction_of_sessions(seen), "hod_lod": Z.extremes_of_sessions(seen), "timing": Z.timing_of_sessions(seen),
            "breakouts": None if name == "asia" else Z.extension_grid(S.breakouts(b).where(own)), "extension": Z.session_range_distributions(r),
        }

    def compute_orb_stats(self, days: int = 120, orb_minutes: int = 15, convention: str = "synthetic_ny") -> dict[str, DataFrame]:
        d = T.enough(S.opening_range(self.bars("5m", days=clamp(days, 1, 180)), convention, max(1, orb_minutes)), LEAST_DAYS)
        return {"days": d, "breakouts": Z.break_summary(d), "extension": Z.opening_extension(d), "day_of_week": Z.opening_weekdays(d)}

    def compute_eth_profile_stats(self, days: int = 90, convention: str = "synthetic_ny") -> dict[str, DataFrame]:
        days = clamp(days, 1, 150)
        d = T.enough(P.prior_profile_touches(self.bars("15m", days=days), self.bars("1h", days=days), convention), LEAST_DAYS)
        return {"days": d, "touch": Z.touch_summary(d), "extension": Z.profile_extension(d), "day_of_week": Z.touch_weekdays(d)}

    # -- studies ----------------------------------------------------------------------------------

    def events(self, days: int, least: int = LEAST_BARS) -> DataFrame:
        """Session events, and structure events of the symbols with enough bars."""
        b = self.bars("1h", days=days, least=least)
        return X.facts(b, B.indexed(T.enough(b, LEAST_SMC_BARS)))

    def run_backtest(self, event_type: str = "", days: int = 365, **conditions: str | None) -> dict[str, DataFrame | list[str]]:
        """Outcome figures of the events of one type that meet the conditions
        (``backtest.CONDITIONS``), by symbol; ``matched`` has their number, ``notes`` are on
        conditions without effect. Without a type the types that there are."""
        if not event_type:
            return {"valid_event_types": list(X.EVENT_TYPES)}
        if event_type not in X.EVENT_TYPES:
            raise ValueError(f"unknown event type {event_type!r}; known: {', '.join(X.EVENT_TYPES)}")
        asked = {"event_type": event_type, **conditions}
        found = X.matching(self.events(clamp(days, 1, 365)), **asked)
        note = F.when(F.col("n") < X.FEW, F.lit(f"fewer than {X.FEW} matches: noise, not an edge"))
        matched = found.groupBy("symbol").agg(F.count("*").alias("n")).withColumn("note", note)
        return {"outcomes": X.outcomes(found, "symbol"), "day_of_week": X.by_weekday(found), "matched": matched, "notes": X.notes(**asked)}

    def discover_edges(self, days: int = 180, min_samples: int = 10, top: int = 15, min_edge_pct: float = 0.0) -> dict[str, DataFrame]:
        e = self.events(clamp(days, 1, 365), LEAST_SMC_BARS)
        far = X.extremes(X.edges(e, min_samples), top, min_edge_pct)
        return {"baselines": X.baselines(e), "edges": far.where("list = 'edges'").orderBy("rank"), "anti_patterns": far.where("list = 'anti_patterns'").orderBy("rank")}

    def backtest_rr(self, event_type: str, days: int = 180, stop_atr_mult: float = 1.0, target_r: float = 2.0, atr_period: int = 14, max_hold_bars: int = 48) -> dict[str, DataFrame]:
        b = self.bars("1h", days=clamp(days, 1, 365), least=LEAST_BARS)
        t = X.trades(b, X.matching(X.session_events(b), event_type=event_type), atr_n=atr_period, stop_mult=stop_atr_mult, target_r=target_r, hold=max_hold_bars)
        return {"trades": t, "statistics": X.equity(t, ["symbol"]), "curve": X.downsampled(t, ["symbol"])}

    # -- bundles ----------------------------------------------------------------------------------

    def _bundle(self, parts: dict) -> dict:
        """The results of endpoints; one that refuses leaves a line in ``gaps``."""
        out: dict = {"gaps": []}
        for name, call in parts.items():
            try:
                out[name] = call()
            except ValueError as refused:
                out["gaps"].append(f"{name}: {refused}")
        return out

    def analyze(self, symbol: str, timeframe: str = "1h", **positioning: DataFrame) -> dict:
        """A symbol's read of now: structure of a higher and of its own timeframe, levels,
        profile, flow, positioning (``get_derivatives``' inputs) and grade."""
        m, name = self.only(symbol), normalize_timeframe(timeframe)
        return self._bundle({
            "higher": lambda: m.analyze_smc("1d" if name == "4h" else "4h"), "structure": lambda: m.analyze_smc(name), "levels": m.get_levels, "market_profile": lambda: m.get_market_profile(name),
            "orderflow": lambda: (crypto_only(symbol), m.get_orderflow("5m"))[1], "derivatives": lambda: get_derivatives([symbol], **positioning) if positioning else _missing("no positioning given"),
            "confluence": m.scan_confluence,
        })

    def brief(self, symbol: str, base: str, timeframe: str = "1h", **positioning: DataFrame) -> dict:
        """The read of :meth:`analyze` for the session ahead: with the clock at the
        symbol's newest trade, session statistics, volatility, correlation with
        ``base`` and the forecast."""
        m = self.only(symbol)
        now = m.index.groupBy("symbol").agg(F.max("last_ts").alias("ts"))
        ahead = m._bundle({
            "clock": lambda: get_session_clock(now), "session_stats": m.compute_session_stats, "volatility": lambda: m.get_volatility(timeframe),
            "correlations": lambda: self.get_correlations([symbol], base) if base != symbol else _missing("the symbol is the base"), "forecast": m.get_session_forecast,
        })
        read = self.analyze(symbol, timeframe, **positioning)
        return {**ahead, **read, "gaps": ahead["gaps"] + read["gaps"]}

    def get_candles(self, timeframe: str = "1h", limit: int = 200) -> DataFrame:
        return self.bars(timeframe, clamp(limit, 1, 1000)).withColumn("iso", F.date_format("bar_ts", "yyyy-MM-dd'T'HH:mm:ss"))


def _missing(why: str):
    raise ValueError(why)


def get_session_clock(times: DataFrame, ts: str = "ts") -> DataFrame:
    return W.session_clock(times, ts)


def get_derivatives(symbols: list[str], funding: DataFrame, period: str = "1h", limit: int = 24, **series: DataFrame | None) -> dict[str, DataFrame]:
    """Funding, open interest, account ratios and taker flow of crypto symbols
    (``flow.derivatives``): ``series`` are open_interest, global_ratio, top_ratio, taker."""
    crypto_only(*symbols)
    if period not in W.PERIOD_HOURS:
        raise ValueError(f"unknown period {period!r}; known: {', '.join(W.PERIOD_HOURS)}")
    own = lambda df: None if df is None else df.where(F.col("symbol").isin(*symbols))
    return W.derivatives(own(funding), period=period, limit=clamp(limit, 1, 500), **{name: own(df) for name, df in series.items()})


def calc_position_size(requests: DataFrame, **options) -> DataFrame:
    return W.position_size(requests, **options)
