"""All queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions import cross, ts
from panelwright.functions.scalar import rounded, signed_log
from panelwright.operators import evaluate, factors, labels, linear, normalize, panel, portfolio, samples, score
from panelwright.operators.calendar import fill_gaps
from panelwright.plans import panel_chain
from panelwright.plans import sql as S
from panelwright.sources import bars as src
from panelwright.sources.scratch import file_system, materialise, scratch_path
from panelwright.sources.store import PanelStore
from panelwright.streaming.bars import all_grains
from panelwright.streaming.bars import intraday_bars as bars_of_events

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
C = F.col


def query(name: str, *parts: str) -> Callable[[Query], Query]:
    """Register a query; ``parts`` are common table expressions and, last, the statement over them."""

    def add(f: Query) -> Query:
        _queries[name] = f
        if parts:
            _sql[name] = (S.chain(*parts[:-1]) if len(parts) > 1 else "") + parts[-1]
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_chain.flagship(daily(spark, sf_dir))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.bars_from_trades(src.table(spark, sf_dir, "lineitem"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.fundamentals_from_trades(src.table(spark, sf_dir, "lineitem"))


def with_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with return ``r`` and log return ``lr``."""
    return daily(spark, sf_dir).withColumns({"r": ts.ts_returns(C("close")), "lr": ts.log_return(C("close"))})


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with three rounded features and the target; rows that have both."""
    df = labels.forward_target(with_base(spark, sf_dir)).drop("high", "low")
    df = ts.with_rolling(df, {"f1": ts.Rolling("sum", 20, "lr"), "f2": ts.Rolling("std", 20, "r"), "f3": ts.Rolling("sum", 20, "volume")})
    return df.where(C("f1").isNotNull() & C("target").isNotNull()).withColumns({"f1": F.round("f1", 9), "f2": F.round("f2", 9), "f3": F.round(F.ln(C("f3") + 1), 9)})


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features(spark, sf_dir)
    df = df.withColumns({f"cs_rank_{f}": (cross.cs_rank(C(f)) - 0.5) * 2 for f in ("f1", "f2", "f3")})
    df = score.composite_score(df).withColumn("score", F.round("score", 9))
    return df.withColumn("label", F.round((C("target") - cross.cs_mean(C("target"))) / 100, 9))


def strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily return of the five best beside the index, scaled down: the fixture's prices jump."""
    picks = score.top_k(predictions(spark, sf_dir), 5)
    daily_returns = picks.groupBy("date").agg((F.avg("target") / 100).alias("strategy"))
    return evaluate.align_returns(daily_returns, evaluate.benchmark_returns(src.index_from_bars(daily(spark, sf_dir))))


def keyed(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("code", "date", *(rounded(x).alias(name) for name, x in columns.items()))


def row_sql(**columns: str) -> str:
    return "SELECT code, date, " + ", ".join(f"{S.r(x)} AS {name}" for name, x in columns.items())


query("flagship_momentum", S.BARS, S.BASE, f"mom AS (SELECT code, date, {S.agg('sum', 'lr', 20)} AS mom FROM base)",
      f"ranked AS (SELECT *, {S.cs_rank('mom')} AS rank FROM mom WHERE mom IS NOT NULL)",
      "placed AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY rank DESC, code) AS place FROM ranked)",
      f"SELECT date, code, place, {S.r('mom')} AS mom, {S.r('rank')} AS rank FROM placed WHERE place <= 5")(flagship)


# Sources and calendar

PROFILE = ("open", "high", "low", "close", "volume")


@query("price_scan_profile", S.BARS, "span AS (SELECT min(date) AS first_date, max(date) AS last_date FROM bars)", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", 'double' AS type, count({c}) AS n, count(*) - count({c}) AS nulls, {S.r(f'min({c})')} AS low, {S.r(f'max({c})')} AS high, {S.r(f'avg({c})', 4)} AS mean, "
    "any_value(first_date) AS first_date, any_value(last_date) AS last_date FROM bars, span" for c in PROFILE))  # fmt: skip
def _(spark, sf_dir):
    found = src.profile(daily(spark, sf_dir), PROFILE)
    return found.withColumns({"low": rounded(C("low")), "high": rounded(C("high")), "mean": rounded(C("mean"), 4)})


@query("min_history", S.BARS, f"{row_sql(close='close')} FROM (SELECT *, count(*) OVER (PARTITION BY code) AS n FROM bars) WHERE n > 30")
def _(spark, sf_dir):
    return keyed(src.min_history(daily(spark, sf_dir)), close=C("close"))


@query("stale_codes", S.BARS, "last AS (SELECT code, max(date) AS d FROM bars GROUP BY code)", "SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS code FROM supplier "
       "WHERE CAST(s_suppkey AS VARCHAR) NOT IN (SELECT code FROM last WHERE d >= (SELECT max(date) FROM bars) - 5)")  # fmt: skip
def _(spark, sf_dir):
    bars = daily(spark, sf_dir)
    universe = src.table(spark, sf_dir, "supplier").select(C("s_suppkey").cast("string").alias("code"))
    return src.stale_codes(universe, bars, bars.select(F.date_sub("date", 5).alias("date")))


@query("refresh_age", "SELECT CAST(o_custkey AS VARCHAR) AS code FROM orders GROUP BY 1 HAVING DATE '1998-08-01' - max(CAST(o_orderdate AS DATE)) >= 90")
def _(spark, sf_dir):
    loads = src.table(spark, sf_dir, "orders").select(C("o_custkey").cast("string").alias("code"), C("o_orderdate").cast("date").alias("loaded_at"))
    return src.needs_refresh(loads, "1998-08-01", 90)


RAW = """raw AS (
    SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS part, CASE WHEN l_returnflag = 'R' THEN 'unknown' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS day,
           CASE WHEN l_linestatus = 'O' THEN '-' ELSE CAST(l_linenumber AS VARCHAR) || '.50' END AS number FROM lineitem
)"""


@query("coerce_clean", RAW, "SELECT k, line, part, TRY_CAST(day AS DATE) AS date, TRY_CAST(number AS DOUBLE) AS number FROM raw WHERE TRY_CAST(day AS DATE) IS NOT NULL AND TRY_CAST(number AS DOUBLE) IS NOT NULL")
def _(spark, sf_dir):
    rows = src.table(spark, sf_dir, "lineitem")
    day = F.when(C("l_returnflag") == "R", "unknown").otherwise(C("l_shipdate").cast("date").cast("string"))
    number = F.when(C("l_linestatus") == "O", "-").otherwise(F.concat(C("l_linenumber").cast("string"), F.lit(".50")))
    raw = rows.select(C("l_orderkey").alias("k"), C("l_linenumber").alias("line"), C("l_partkey").alias("part"), day.alias("trade_day"), number.alias("number"))
    return src.canonical(raw, {"trade_day": "date", "absent": "other"}, ["number"])


@query("coerce_times", "SELECT event_id, ts, value FROM events WHERE event_id % 3 > 0 AND ts IS NOT NULL AND value IS NOT NULL")
def _(spark, sf_dir):
    text = F.when(C("event_id") % 3 > 0, C("ts").cast("string")).otherwise("soon")
    raw = src.table(spark, sf_dir, "events").select("event_id", text.alias("datetime"), C("value").cast("string").alias("value"))
    return src.canonical(raw, {"datetime": "ts"}, ["value"], times=["ts"])


@query("stored_panel", S.BARS, f"{row_sql(close='close')} FROM bars")
def _(spark, sf_dir):
    stored = src.materialise_panel(daily(spark, sf_dir), scratch_path(spark), "1998-12-31", "train")
    return keyed(stored, close=C("close"))


@query("panel_refresh", S.BARS, S.BASE, f"{row_sql(close='close', r='r')} FROM base")
def _(spark, sf_dir):
    """A stored panel of returns whose every third code lacks its last 200 days, brought up to date."""
    bars = daily(spark, sf_dir)
    build = lambda some: some.select("code", "date", "close", ts.ts_returns(C("close")).alias("r"))
    last = F.max("date").over(ts.Window.partitionBy("code"))
    old = bars.withColumn("_last", last).where((C("code").cast("int") % 3 > 0) | (C("date") < F.date_sub("_last", 200))).drop("_last")
    store = PanelStore(spark, scratch_path(spark), buckets=16)
    store.replace_all(build(old))
    store.refresh(bars.select("code"), bars, bars.select(F.date_sub("date", 5).alias("date")), build)
    return keyed(store.read(), close=C("close"), r=C("r"))


@query("describe_bars", S.BARS, " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, {S.r(f'avg({c})', 4)} AS mean, {S.r(f'stddev_samp({c})', 4)} AS sd, {S.r(f'min({c})')} AS min, "
    f"{', '.join(f'{S.r(f"quantile_disc({c}, {q / 100})")} AS q{q}' for q in (25, 50, 75))}, {S.r(f'max({c})')} AS max FROM bars" for c in PROFILE))  # fmt: skip
def _(spark, sf_dir):
    found = src.describe(daily(spark, sf_dir), PROFILE)
    return found.withColumns({c: rounded(C(c), 4 if c in ("mean", "sd") else 6) for c in ("mean", "sd", "min", "q25", "q50", "q75", "max")})


def code_folder(spark: SparkSession, rows: DataFrame, suffix: str = ".parquet") -> str:
    """A folder with a file for each code of ``rows``, and one that cannot be read."""
    path = scratch_path(spark)
    src.write_code_files(rows, path, suffix)
    files, bad = file_system(spark, f"{path}/broken{suffix}")
    stream = files.create(bad)
    stream.write(bytearray(b"PAR1 is not all that a file needs" * 100))
    stream.close()
    return path


@query("price_scan", S.BARS, f"SELECT code, date, {', '.join(f'{S.r(f"CAST(CAST({c} AS FLOAT) AS DOUBLE)", 3)} AS {c}' for c in PROFILE)} FROM bars")
def _(spark, sf_dir):
    found = src.read_bars(spark, code_folder(spark, daily(spark, sf_dir)), narrow=True)
    return found.select("code", "date", *(rounded(C(c).cast("double"), 3).alias(c) for c in PROFILE))


@query("fundamental_scan", S.BARS, S.FUNDAMENTALS, f"{row_sql(**{c: c for c in src.FUNDAMENTALS if c != 'pb'})} FROM fundamentals")
def _(spark, sf_dir):
    found = src.read_fundamentals(spark, code_folder(spark, reports(spark, sf_dir).drop("pb")))
    return keyed(found, **{c: C(c) for c in src.FUNDAMENTALS if c != "pb"})


@query("bar_sink", S.BARS, f"{row_sql(close='close')} FROM bars")
def _(spark, sf_dir):
    path = scratch_path(spark)
    name = f"bars_{path[-32:]}"
    src.write_bars(daily(spark, sf_dir), name, buckets=8, path=path)
    return keyed(spark.table(name), close=C("close"))


@query("random_code", S.BARS, f"{row_sql(close='close')} FROM bars WHERE code = (SELECT code FROM (SELECT DISTINCT code FROM bars) ORDER BY md5(code || '-7'), code LIMIT 1)")
def _(spark, sf_dir):
    return keyed(src.sample_code(daily(spark, sf_dir), 7), close=C("close"))


@query("unfinished_codes", "SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS code FROM supplier WHERE s_suppkey % 2 = 1 OR CAST(s_suppkey AS VARCHAR) NOT IN (SELECT CAST(l_suppkey AS VARCHAR) FROM lineitem)")
def _(spark, sf_dir):
    """Suppliers of even number have a file of bars, the others one with their first date alone, under 1 KiB."""
    universe, bars = src.table(spark, sf_dir, "supplier").select(C("s_suppkey").cast("string").alias("code")), daily(spark, sf_dir)
    even = C("code").cast("int") % 2 == 0
    path = code_folder(spark, bars.where(even), "_daily.parquet")
    src.write_code_files(bars.where(~even).groupBy("code").agg(F.min("date").alias("date")), path, "_daily.parquet")
    return src.unfinished_codes(universe, src.code_files(spark, path, "_daily.parquet"))


@query("head_tail", S.BARS, f"({row_sql(close='close')}, 'head' AS part FROM bars ORDER BY code, date LIMIT 5) UNION ALL ({row_sql(close='close')}, 'tail' AS part FROM bars ORDER BY code DESC, date DESC LIMIT 5)")
def _(spark, sf_dir):
    bars = keyed(daily(spark, sf_dir), close=C("close"))
    return src.head(bars).withColumn("part", F.lit("head")).unionByName(src.tail(bars).withColumn("part", F.lit("tail")))


@query("code_boundaries", S.BARS, f"{row_sql(close='close')} FROM (SELECT *, lag(code) OVER (ORDER BY code, date) AS before FROM bars) WHERE before IS NULL OR before <> code")
def _(spark, sf_dir):
    return keyed(samples.code_boundaries(daily(spark, sf_dir)), close=C("close"))


GAP_FILL = """days AS (SELECT code, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM bars GROUP BY code),
dense AS (SELECT d.code, d.date, open, high, low, close, coalesce(volume, 0) AS volume FROM days d LEFT JOIN bars b ON b.code = d.code AND b.date = d.date),
filled AS (SELECT code, date, """ + ", ".join(f"last_value({c} IGNORE NULLS) OVER {S.SO_FAR} AS {c}" for c in PROFILE[:4]) + """, volume FROM dense)"""


@query("gap_fill", S.BARS, GAP_FILL, f"{row_sql(open='open', high='high', low='low', close='close', volume='volume')} FROM filled WHERE isodow(date) < 6")
def _(spark, sf_dir):
    return keyed(fill_gaps(daily(spark, sf_dir)), **{c: C(c) for c in PROFILE})


ALIVE = f"alive AS (SELECT *, row_number() OVER {S.W} - 1 AS age FROM filled WHERE isodow(date) < 6 AND volume > 0 AND close >= 1000)"


@query("universe_filter", S.BARS, GAP_FILL, ALIVE, f"{row_sql(close='close', volume='volume')} FROM alive WHERE age > 60")
def _(spark, sf_dir):
    return keyed(panel.universe_filter(fill_gaps(daily(spark, sf_dir)), min_price=1000.0), close=C("close"), volume=C("volume"))


@query("filter_report", S.BARS, GAP_FILL, ALIVE, "counts AS (SELECT (SELECT count(*) FROM filled WHERE isodow(date) < 6) AS n_before, (SELECT count(*) FROM alive WHERE age > 60) AS n_after)",
       f"SELECT n_before, n_before - n_after AS n_removed, {S.r('(n_before - n_after) / n_before')} AS share FROM counts")
def _(spark, sf_dir):
    return panel.filter_report(fill_gaps(daily(spark, sf_dir)), panel.in_universe(min_price=1000.0)).withColumn("share", rounded(C("share")))


@query("observed_filter", S.BARS, GAP_FILL, ALIVE, "SELECT (SELECT count(*) FROM filled WHERE isodow(date) < 6) AS n_before, (SELECT count(*) FROM alive WHERE age > 60) AS n_after, "
       "(SELECT count(*) FROM alive WHERE age > 60) AS n_written")  # fmt: skip
def _(spark, sf_dir):
    rows, seen = panel.observed_filter(fill_gaps(daily(spark, sf_dir)), panel.in_universe(min_price=1000.0))
    written = materialise(rows)
    return written.agg(F.count("*").alias("n_written")).select(F.lit(seen.get["n_before"]).cast("long").alias("n_before"), F.lit(seen.get["n_after"]).cast("long").alias("n_after"), "n_written")


@query("still_trading", S.BARS, "SELECT code, count(*) AS n FROM bars WHERE code IN (SELECT code FROM bars GROUP BY code HAVING max(date) = (SELECT max(date) FROM bars)) GROUP BY code")
def _(spark, sf_dir):
    return panel.still_trading(daily(spark, sf_dir)).groupBy("code").agg(F.count("*").alias("n"))


@query("latest_slice", S.BARS, f"{row_sql(close='close')} FROM bars WHERE date = (SELECT max(date) FROM bars)")
def _(spark, sf_dir):
    return keyed(panel.latest_slice(daily(spark, sf_dir)), close=C("close"))


@query("date_slice", S.BARS, f"{row_sql(close='close')} FROM (SELECT *, count(*) OVER (PARTITION BY code) AS n FROM bars "
       "WHERE date BETWEEN DATE '1996-01-01' - 60 AND DATE '1996-12-31') WHERE n >= 30")  # fmt: skip
def _(spark, sf_dir):
    part = panel.slice_dates(daily(spark, sf_dir), F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date"))
    return keyed(panel.enough_context(part), close=C("close"))


ASOF = """avail AS (SELECT *, date + 60 AS at FROM fundamentals),
joined AS (SELECT b.*, f.roe, f.rev_growth, f.profit_growth, f.debt_ratio, f.pe_ttm, f.pb FROM bars b ASOF LEFT JOIN avail f ON b.code = f.code AND b.date >= f.at)"""
SIX = src.FUNDAMENTALS


@query("asof_fundamentals", S.BARS, S.FUNDAMENTALS, ASOF, f"{row_sql(close='close', **{c: c for c in SIX})} FROM joined")
def _(spark, sf_dir):
    joined = panel.asof_fundamentals(daily(spark, sf_dir), reports(spark, sf_dir))
    return keyed(joined, close=C("close"), **{c: C(c) for c in SIX})


# Rolling operators: (name, Spark columns, SQL columns) over bars with r and lr

def _rolling(name: str, spark_columns: Callable[[], dict[str, Column]], sql_columns: dict[str, str]) -> None:
    @query(name, S.BARS, S.BASE, f"{row_sql(**sql_columns)} FROM base")
    def _(spark, sf_dir):
        return keyed(with_base(spark, sf_dir), **spark_columns())


_rolling("ts_mean", lambda: {"mean_5": ts.ts_mean(C("close"), 5), "mean_20": ts.ts_mean(C("r"), 20)}, {"mean_5": S.agg("avg", "close", 5), "mean_20": S.agg("avg", "r", 20)})
_rolling("ts_std", lambda: {"std_5": ts.ts_std(C("close"), 5), "std_20": ts.ts_std(C("r"), 20)}, {"std_5": S.agg("stddev_samp", "close", 5), "std_20": S.agg("stddev_samp", "r", 20)})
_rolling("ts_sum", lambda: {"sum_20": ts.ts_sum(C("lr"), 20), "sum_120": ts.ts_sum(C("volume"), 120)}, {"sum_20": S.agg("sum", "lr", 20), "sum_120": S.agg("sum", "volume", 120)})
_rolling("ts_minmax", lambda: {"max_20": ts.ts_max(C("r"), 20), "min_9": ts.ts_min(C("low"), 9)}, {"max_20": S.agg("max", "r", 20), "min_9": S.agg("min", "low", 9)})
_rolling("delta_delay", lambda: {"delta_5": ts.delta(C("close"), 5), "delay_3": ts.delay(C("close"), 3), "lead_2": ts.delay(C("close"), -2)},
         {"delta_5": f"close - {S.lag('close', 5)}", "delay_3": S.lag("close", 3), "lead_2": S.lag("close", -2)})
_rolling("ts_rank", lambda: {"rank_5": ts.ts_rank(C("close"), 5), "rank_10": ts.ts_rank(C("volume"), 10)}, {"rank_5": S.ts_rank("close", 5), "rank_10": S.ts_rank("volume", 10)})
_rolling("decay_linear", lambda: {"decay_10": ts.decay_linear(C("close"), 10)}, {"decay_10": S.decay("close", 10)})
_rolling("ts_corr", lambda: {"corr_10": ts.ts_corr(C("open"), C("volume"), 10)}, {"corr_10": S.corr("open", "volume", 10)})
_rolling("ts_cov", lambda: {"cov_20": ts.ts_cov(C("r"), C("lr"), 20)}, {"cov_20": S.full(20, f"covar_samp(r, lr) OVER {S.frame(20)}", "r", "lr")})
_rolling("ts_skew", lambda: {"skew_20": ts.ts_skew(C("r"), 20)}, {"skew_20": S.moment("skewness", "r", 20)})
_rolling("ts_kurt", lambda: {"kurt_20": ts.ts_kurt(C("r"), 20)}, {"kurt_20": S.moment("kurtosis", "r", 20)})
_rolling("returns_log", lambda: {"r_3": ts.ts_returns(C("close"), 3), "lr": C("lr"), "safe": ts.F.ln(F.abs(C("r")) + 1e-9)},
         {"r_3": f"close / {S.lag('close', 3)} - 1", "lr": "lr", "safe": "ln(abs(r) + 1e-9)"})
_rolling("rolling_zscore", lambda: {"z_60": ts.rolling_zscore(C("close"), 60)}, {"z_60": S.zscore("close", 60)})
_rolling("cum_vwap", lambda: {"vwap": ts.cum_sum(C("volume") * (C("high") + C("low") + C("close")) / 3) / (ts.cum_sum(C("volume")) + 1e-9), "n": ts.cum_count().cast("double")},
         {"vwap": f"sum(volume * (high + low + close) / 3) OVER {S.SO_FAR} / (sum(volume) OVER {S.SO_FAR} + 1e-9)", "n": f"CAST(row_number() OVER {S.W} - 1 AS DOUBLE)"})


LONG = {
    "mean_250": (ts.Rolling("mean", 250, "close"), S.agg("avg", "close", 250)), "sum_120": (ts.Rolling("sum", 120, "lr"), S.agg("sum", "lr", 120)),
    "std_250": (ts.Rolling("std", 250, "r"), S.agg("stddev_samp", "r", 250)), "std_20": (ts.Rolling("std", 20, "r"), S.agg("stddev_samp", "r", 20)),
    "max_250": (ts.Rolling("max", 250, "high"), S.agg("max", "high", 250)), "min_60": (ts.Rolling("min", 60, "low"), S.agg("min", "low", 60)),
    "corr_120": (ts.Rolling("corr", 120, "open", "volume"), S.corr("open", "volume", 120)), "skew_250": (ts.Rolling("skew", 250, "r"), S.moment("skewness", "r", 250)),
    "cov_250": (ts.Rolling("cov", 250, "r", "lr"), S.full(250, f"covar_samp(r, lr) OVER {S.frame(250)}", "r", "lr")), "kurt_250": (ts.Rolling("kurt", 250, "r"), S.moment("kurtosis", "r", 250)),
}


@query("rolling_long", S.BARS, S.BASE, f"{row_sql(**{c: x for c, (_, x) in LONG.items()})} FROM base")
def _(spark, sf_dir):
    return keyed(ts.with_rolling(with_base(spark, sf_dir), {c: r for c, (r, _) in LONG.items()}), **{c: C(c) for c in LONG})


@query("ewm_span", S.BARS, S.ewm("e", "bars", {"e12": ("close", 2 / 13, False), "e26": ("close", 2 / 27, False)}), f"{row_sql(e12='e12', e26='e26')} FROM e")
def _(spark, sf_dir):
    df = ts.with_ewm(daily(spark, sf_dir), [("e12", "close", 2 / 13, False), ("e26", "close", 2 / 27, False)])
    return keyed(df, e12=C("e12"), e26=C("e26"))


@query("ewm_com", S.BARS, S.ewm("e", "bars", {"e2": ("close", 1 / 3, True), "e9": ("volume", 1 / 10, True)}), f"{row_sql(e2='e2', e9='e9')} FROM e")
def _(spark, sf_dir):
    df = ts.with_ewm(daily(spark, sf_dir), [("e2", "close", 1 / 3, True), ("e9", "volume", 1 / 10, True)])
    return keyed(df, e2=C("e2"), e9=C("e9"))


# Factors

FACTOR_SQL = {
    "style": {
        "style_mom_1m": S.agg("sum", "lr", 20), "style_mom_3m": S.agg("sum", "lr", 60), "style_mom_6m": S.agg("sum", "lr", 120),
        "style_vol_1m": S.agg("stddev_samp", "r", 20), "style_vol_3m": S.agg("stddev_samp", "r", 60),
        "style_liquidity": f"ln({S.agg('sum', 'volume', 20)} + 1)", "style_size_proxy": "ln(close * volume + 1)", "style_beta_proxy": S.corr("r", "r1", 20),
    },
    "alpha": {
        "alpha_006": f"-({S.corr('open', 'volume', 10)})", "alpha_012": f"sign(volume - {S.lag('volume', 1)}) * -dc", "alpha_trend_strength": S.agg("avg", "spread", 14),
        "alpha_pv_corr": S.corr("rank_c", "rank_v", 5), "alpha_money_flow": S.decay("clv", 20),
    },
    "adv": {
        "adv_skew_20": S.moment("skewness", "r", 20), "adv_kurt_20": S.moment("kurtosis", "r", 20), "adv_downside_vol": S.agg("stddev_samp", "loss", 20),
        "adv_ker_10": f"abs(close - {S.lag('close', 10)}) / ({S.agg('sum', 'abs_dc', 10)} + 1e-9)", "adv_amihud": "abs(r) / (close * volume + 1e-9) * 1e6",
        "adv_spread_proxy": S.agg("avg", "log_hl", 5), "adv_vol_of_vol": S.agg("stddev_samp", "sd5", 20),
    },
    "ind": {
        "ind_yang_zhang_vol": "CASE WHEN yz >= 0 THEN sqrt(yz) END", "ind_roll_spread": "2 * sqrt(CASE WHEN cov > 0 THEN 0 ELSE -cov END + 1e-9)",
        "ind_max_ret": S.agg("max", "r", 20), "ind_vol_cv": f"{S.agg('stddev_samp', 'volume', 20)} / ({S.agg('avg', 'volume', 20)} + 1e-9)",
        "ind_smart_money": "abs(close - open) / (high - low + 1e-9) * ln(volume + 1)",
    },
    "time": {"time_dow": "(isodow(date) - 3) / 2.0", "time_dom": "(day(date) - 15) / 15.0", "time_moy": "(month(date) - 6.5) / 5.5"},
    "tech": {
        "tech_macd_hist": "2 * (dif - dea)", "tech_rsi_14": f"100 - 100 / (1 + {S.agg('avg', 'up', 14)} / ({S.agg('avg', 'down', 14)} + 1e-9))",
        "tech_bias_20": "(close - ma20) / ma20", "tech_psy_12": f"{S.agg('sum', 'rises', 12)} / 12", "tech_kdj_k": "kk", "tech_kdj_d": "dd", "tech_kdj_j": "3 * kk - 2 * dd",
        "tech_bb_width": "4 * sd20 / (ma20 + 1e-9)", "tech_bb_pctb": "(close - (ma20 - 2 * sd20)) / (4 * sd20 + 1e-9)",
    },
}
STAGE_SQL = {
    "alpha": (f"more AS (SELECT *, {S.ts_rank('close', 5)} AS rank_c, {S.ts_rank('volume', 5)} AS rank_v FROM derived)", "more"),
    "ind": (
        f"parts AS (SELECT *, {S.agg('stddev_samp', 'log_oc', 20)} AS a, {S.agg('stddev_samp', 'log_co', 20)} AS b, {S.agg('avg', 'rs', 20)} AS c, "
        f"{S.full(20, f'covar_samp(dc, dc1) OVER {S.frame(20)}', 'dc', 'dc1')} AS cov FROM derived), more AS (SELECT *, a * a + 0.34 * b * b + 0.66 * c AS yz FROM parts)",
        "more",
    ),
    "tech": (
        ",\n".join([
            S.ewm("e", "derived", {"e12": ("close", 2 / 13, False), "e26": ("close", 2 / 27, False)}), "difs AS (SELECT code, date, e12 - e26 AS dif FROM e)",
            S.ewm("f", "difs", {"dea": ("dif", 2 / 10, False)}), "rsvs AS (SELECT code, date, rsv FROM derived WHERE rsv IS NOT NULL)",
            S.ewm("g", "rsvs", {"kk": ("rsv", 1 / 3, True)}), "ks AS (SELECT code, date, kk FROM g)", S.ewm("h", "ks", {"dd": ("kk", 1 / 3, True)}),
            "more AS (SELECT d.*, dif, dea, kk, dd FROM derived d JOIN difs USING (code, date) JOIN f USING (code, date) LEFT JOIN ks USING (code, date) LEFT JOIN h USING (code, date))",
        ]),
        "more",
    ),
}


def _family(name: str) -> None:
    extra, table = STAGE_SQL.get(name, ("", "derived"))
    parts = [S.BARS, S.BASE, *([extra] if extra else []), f"{row_sql(**FACTOR_SQL[name])} FROM {table}"]

    @query("calendar_factors" if name == "time" else f"{name}_factors", *parts)
    def _(spark, sf_dir):
        df = factors.with_factors(daily(spark, sf_dir), (name,))
        return keyed(df, **{c: C(c) * 1e6 if c == "adv_amihud" else C(c) for c in FACTOR_SQL[name]})


for _name in FACTOR_SQL:
    _family(_name)

FUND_SQL = {"fund_ep": "1 / (coalesce(pe_ttm, 0) + 1e-9)", "fund_bp": "1 / (coalesce(pb, 0) + 1e-9)", "fund_roe": "coalesce(roe, 0)", "fund_growth": "coalesce(profit_growth, 0)", "fund_safety": "-coalesce(debt_ratio, 0)"}


@query("fund_factors", S.BARS, S.FUNDAMENTALS, ASOF, f"{row_sql(**FUND_SQL)} FROM joined")
def _(spark, sf_dir):
    joined = panel.fill_fundamentals(panel.asof_fundamentals(daily(spark, sf_dir), reports(spark, sf_dir)))
    return keyed(factors.with_factors(joined, ("fund",)), **{c: C(c) for c in factors.FUND})


NORMAL = {"style_mom_1m": FACTOR_SQL["style"]["style_mom_1m"], "style_liquidity": FACTOR_SQL["style"]["style_liquidity"], "adv_spread_proxy": FACTOR_SQL["adv"]["adv_spread_proxy"]}
FILLED = (
    "raw AS (SELECT code, date, " + ", ".join(f"{x} AS {c}" for c, x in NORMAL.items()) + " FROM derived)",
    "whole AS (SELECT code, date, " + ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER {S.SO_FAR}, 0) AS {c}" for c in NORMAL) + " FROM raw)",
    "normed AS (SELECT code, date, " + ", ".join(f"{S.normal(c)} AS {c}" for c in NORMAL) + " FROM whole)",
)


def _normed(spark, sf_dir):
    df = factors.with_factors(daily(spark, sf_dir), ("style", "adv")).select("code", "date", *NORMAL)
    return normalize.normalize(df, ordered=True)


@query("normalize_factors", S.BARS, S.BASE, *FILLED, f"{row_sql(**{c: c for c in NORMAL})} FROM normed")
def _(spark, sf_dir):
    return keyed(_normed(spark, sf_dir), **{c: C(c) for c in NORMAL})


@query("labelled_tail", S.BARS, f"{row_sql(target='target')} FROM (SELECT *, {S.lag('close', -5)} / {S.lag('open', -1)} - 1 AS target FROM bars) WHERE target IS NOT NULL")
def _(spark, sf_dir):
    return keyed(panel.labelled(labels.forward_target(daily(spark, sf_dir)), "train"), target=C("target"))


FEATURES = {"style_mom_1m": FACTOR_SQL["style"]["style_mom_1m"], "adv_downside_vol": FACTOR_SQL["adv"]["adv_downside_vol"], "ind_max_ret": FACTOR_SQL["ind"]["ind_max_ret"]}


@query("feature_table", S.BARS, S.BASE, f"SELECT code, date, {', '.join(f'{S.r(f"CAST(CAST(coalesce({x}, 0) AS FLOAT) AS DOUBLE)", 4)} AS {c}' for c, x in FEATURES.items())} FROM derived")
def _(spark, sf_dir):
    table = panel.feature_table(factors.with_factors(daily(spark, sf_dir), ("style", "adv", "ind")).select("code", "date", "close", *FEATURES))
    return table.select("code", "date", *(rounded(C(c).cast("double"), 4).alias(c) for c in FEATURES))


ALL15 = {
    **{c: FACTOR_SQL["style"][c] for c in ("style_mom_1m", "style_vol_1m", "style_liquidity")}, "alpha_money_flow": FACTOR_SQL["alpha"]["alpha_money_flow"],
    "adv_skew_20": FACTOR_SQL["adv"]["adv_skew_20"], "alpha_006": FACTOR_SQL["alpha"]["alpha_006"], "ind_max_ret": FACTOR_SQL["ind"]["ind_max_ret"],
}
FIFTEEN = (
    STAGE_SQL["ind"][0].replace("more AS", "inds AS"), STAGE_SQL["tech"][0].replace("more AS", "techs AS"),
    "plain AS (SELECT code, date, " + ", ".join(f"{x} AS {c}" for c, x in ALL15.items()) + " FROM derived)",
    "ind2 AS (SELECT code, date, " + ", ".join(f"{FACTOR_SQL['ind'][c]} AS {c}" for c in ("ind_yang_zhang_vol", "ind_roll_spread")) + " FROM inds)",
    "tech3 AS (SELECT code, date, " + ", ".join(f"{FACTOR_SQL['tech'][c]} AS {c}" for c in ("tech_rsi_14", "tech_kdj_j", "tech_bb_width")) + " FROM techs)",
    "fund3 AS (SELECT code, date, " + ", ".join(f"{FUND_SQL[c]} AS {c}" for c in ("fund_ep", "fund_roe", "fund_growth")) + " FROM joined)",
    "fifteen AS (SELECT code, date, " + ", ".join(f"round({c}, 7) AS {c}" for c in normalize.RANKED) + " FROM plain JOIN ind2 USING (code, date) JOIN tech3 USING (code, date) JOIN fund3 USING (code, date))",
    "meds AS (SELECT *, " + ", ".join(f"median({c}) OVER (PARTITION BY date) AS m_{c}" for c in normalize.RANKED) + " FROM fifteen)",
    "mads AS (SELECT *, " + ", ".join(f"median(abs({c} - m_{c})) OVER (PARTITION BY date) AS d_{c}" for c in normalize.RANKED) + " FROM meds)",
    "clips AS (SELECT code, date, " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, m_{c} - 3 * 1.4826 * d_{c}), m_{c} + 3 * 1.4826 * d_{c}) END AS {c}" for c in normalize.RANKED) + " FROM mads)",
)


@query("cross_ranks", S.BARS, S.BASE, S.FUNDAMENTALS, ASOF, *FIFTEEN, f"{row_sql(**{f'cs_rank_{c}': f'({S.cs_rank(c)} - 0.5) * 2' for c in normalize.RANKED})} FROM clips")
def _(spark, sf_dir):
    joined = panel.fill_fundamentals(panel.asof_fundamentals(daily(spark, sf_dir), reports(spark, sf_dir)))
    wide = factors.with_factors(joined).select("code", "date", *(F.round(c, 7).alias(c) for c in normalize.RANKED))
    return keyed(normalize.cross_ranks(wide), **{f"cs_rank_{c}": C(f"cs_rank_{c}") for c in normalize.RANKED})


# Cross-section

@query("forward_target", S.BARS, f"{row_sql(target=f'{S.lag("close", -5)} / {S.lag("open", -1)} - 1', simple=f'{S.lag("close", -5)} / close - 1')} FROM bars")
def _(spark, sf_dir):
    df = labels.forward_target(daily(spark, sf_dir)).withColumnRenamed("target", "t")
    return keyed(labels.simple_target(df), target=C("t"), simple=C("target"))


FEATS = (S.BARS, S.BASE, S.PREDICTIONS)
BY_DATE = "OVER (PARTITION BY date)"


@query("cs_rank", *FEATS, f"{row_sql(f1=S.cs_rank('f1'), volume=S.cs_rank('volume'))} FROM alive")
def _(spark, sf_dir):
    return keyed(features(spark, sf_dir), f1=cross.cs_rank(C("f1")), volume=cross.cs_rank(C("volume")))


@query("cs_zscore", *FEATS, f"{row_sql(z=f'CASE WHEN stddev_samp(f1) {BY_DATE} > 0 THEN (f1 - avg(f1) {BY_DATE}) / stddev_samp(f1) {BY_DATE} END')} FROM alive")
def _(spark, sf_dir):
    return keyed(features(spark, sf_dir), z=cross.cs_zscore(C("f1")))


@query("winsorize_mad", *FEATS, f"med AS (SELECT *, median(f2) {BY_DATE} AS m FROM alive)", f"mad AS (SELECT *, median(abs(f2 - m)) {BY_DATE} AS d FROM med)",
       f"clipped AS (SELECT *, least(greatest(f2, m - 3 * 1.4826 * d), m + 3 * 1.4826 * d) AS w FROM mad)", f"{row_sql(w='w', rank=f'({S.cs_rank("round(w, 9)")} - 0.5) * 2')} FROM clipped")
def _(spark, sf_dir):
    df = normalize.winsorize(features(spark, sf_dir), ["f2"], suffix="_w").withColumn("f2_r", F.round("f2_w", 9))
    return keyed(df, w=C("f2_w"), rank=(cross.cs_rank(C("f2_r")) - 0.5) * 2)


@query("market_relative", *FEATS, f"{row_sql(mkt_mean_f1=f'avg(f1) {BY_DATE}', rel_f1=f'f1 - avg(f1) {BY_DATE}')} FROM alive")
def _(spark, sf_dir):
    return keyed(normalize.market_relative(features(spark, sf_dir), ["f1", "absent"]), mkt_mean_f1=C("mkt_mean_f1"), rel_f1=C("rel_f1"))


def _z(x: str) -> str:
    return f"({x} - avg({x}) {BY_DATE}) / (stddev_pop({x}) {BY_DATE} + 1e-9)"


ORTHO = (
    f"zed AS (SELECT code, date, {_z('f1')} AS a, {_z('f2')} AS b FROM alive)",
    f"gram AS (SELECT *, avg(a * a) {BY_DATE} AS aa, avg(b * b) {BY_DATE} AS bb, avg(a * b) {BY_DATE} AS ab FROM zed)",
    # inverse root of [[aa, ab], [ab, bb]] by its closed form: with s = sqrt(det) and t = sqrt(trace + 2 s); of one direction alone, the matrix over trace ** 1.5
    "root AS (SELECT *, greatest(aa * bb - ab * ab, 0) AS det, sqrt(greatest(aa * bb - ab * ab, 0)) AS s, sqrt(aa + bb + 2 * sqrt(greatest(aa * bb - ab * ab, 0))) AS t FROM gram)",
    "mixed AS (SELECT code, date, CASE WHEN det > 1e-10 * (aa + bb) * (aa + bb) THEN ((bb + s) * a - ab * b) / (s * t) WHEN aa + bb > 0 THEN (aa * a + ab * b) / pow(aa + bb, 1.5) ELSE 0 END AS p, "
    "CASE WHEN det > 1e-10 * (aa + bb) * (aa + bb) THEN ((aa + s) * b - ab * a) / (s * t) WHEN aa + bb > 0 THEN (ab * a + bb * b) / pow(aa + bb, 1.5) ELSE 0 END AS q FROM root)",
)


@query("orthogonalize_2", *FEATS, *ORTHO, f"SELECT code, date, {S.r(_z('p'), 4)} AS p, {S.r(_z('q'), 4)} AS q FROM mixed")
def _(spark, sf_dir):
    df = features(spark, sf_dir).select("code", "date", C("f1").alias("style_p"), C("f2").alias("style_q"))
    out = normalize.orthogonalize(df)
    return out.select("code", "date", rounded(C("style_p"), 4).alias("p"), rounded(C("style_q"), 4).alias("q"))


@query("orthogonalize_8")
def _(spark, sf_dir):
    df = materialise(normalize.normalize(factors.with_factors(daily(spark, sf_dir), ("style",)).select("code", "date", *factors.STYLE), ordered=True))
    return keyed(normalize.orthogonalize(df), **{c: C(c) for c in factors.STYLE})


@query("labels", *FEATS, f"{row_sql(rank_label=S.cs_rank('target'), excess_label=f'target - avg(target) {BY_DATE}')} FROM alive")
def _(spark, sf_dir):
    return keyed(labels.date_labels(features(spark, sf_dir)), rank_label=C("rank_label"), excess_label=C("excess_label"))


@query("standard_scale", S.BARS, row_sql(x="(close - avg(close) OVER c) / CASE WHEN stddev_pop(close) OVER c = 0 THEN 1 ELSE stddev_pop(close) OVER c END") + " FROM bars WINDOW c AS (PARTITION BY code)")
def _(spark, sf_dir):
    return keyed(normalize.standard_scale(daily(spark, sf_dir), ["close"]), x=C("close"))


@query("full_panel")
def _(spark, sf_dir):
    return panel_chain.build_panel(daily(spark, sf_dir), reports(spark, sf_dir), fill=True, narrow=True)  # features as from panel.feature_table


# Evaluation

RANKS = """ranks AS (
    SELECT date, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0 AS a,
           rank() OVER (PARTITION BY date ORDER BY label) + (count(*) OVER (PARTITION BY date, label) - 1) / 2.0 AS b FROM predictions
),
ics AS (SELECT date, CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN round(corr(a, b), 12) END AS ic FROM ranks GROUP BY date)"""


@query("rank_ic_daily", *FEATS, RANKS, f"SELECT date, {S.r('ic')} AS ic FROM ics")
def _(spark, sf_dir):
    return evaluate.rank_ic(predictions(spark, sf_dir)).select("date", rounded(C("ic")).alias("ic"))


@query("ic_summary", *FEATS, RANKS, f"SELECT {S.r('avg(ic)')} AS mean_ic, {S.r('avg(ic) / (stddev_samp(ic) + 1e-9) * sqrt(252)')} AS icir, {S.r('avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END)')} AS win_share FROM ics")
def _(spark, sf_dir):
    one = evaluate.ic_summary(evaluate.rank_ic(predictions(spark, sf_dir)))
    return one.select(*(rounded(C(c)).alias(c) for c in one.columns))


@query("pooled_ic", *FEATS, "ranks AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS a, rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2.0 AS b FROM predictions)",
       f"SELECT {S.r('corr(a, b)')} AS ic FROM ranks")
def _(spark, sf_dir):
    return evaluate.pooled_ic(predictions(spark, sf_dir)).select(rounded(C("ic")).alias("ic"))


@query("quantile_layers", *FEATS, S.LAYERS, f"SELECT date, layer, {S.r('label')} AS label, n FROM layers")
def _(spark, sf_dir):
    return evaluate.quantile_layers(predictions(spark, sf_dir)).withColumn("label", rounded(C("label")))


def _layers(spark, sf_dir):
    return evaluate.layer_pivot(evaluate.quantile_layers(predictions(spark, sf_dir)))


@query("layer_curve", *FEATS, S.LAYERS, "SELECT date, " + ", ".join(S.r(S.signed_log(f"product(1 + layer_{k}) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)")) + f" AS log_{k}" for k in range(5)) + " FROM wide")
def _(spark, sf_dir):
    curve = evaluate.layer_curve(_layers(spark, sf_dir))
    return curve.select("date", *(rounded(signed_log(C(c))).alias(c.replace("curve", "log")) for c in curve.columns[1:]))


@query("long_short", *FEATS, S.LAYERS, f"SELECT date, {S.r('layer_4 - layer_0')} AS spread, {S.r(S.signed_log('product(1 + layer_4 - layer_0) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)'))} AS log_curve FROM wide")
def _(spark, sf_dir):
    both = evaluate.long_short(_layers(spark, sf_dir))
    return both.select("date", rounded(C("spread")).alias("spread"), rounded(signed_log(C("curve"))).alias("log_curve"))


SCREEN = ", ".join(f"{S.corr(f, 'target', 60)} AS c_{f}" for f in ("f1", "f2", "f3"))


@query("factor_screen", *FEATS, f"wide AS (SELECT {SCREEN} FROM alive)", "long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS factor, c_{f} AS c FROM wide" for f in ("f1", "f2", "f3")) + ")",
       f"SELECT factor, {S.r('avg(c)')} AS ic, {S.r('avg(c) / (stddev_samp(c) + 1e-9)')} AS ir, abs(avg(c)) > 0.01 AS selected FROM long GROUP BY factor")
def _(spark, sf_dir):
    found = evaluate.factor_screen(features(spark, sf_dir), ["f1", "f2", "f3"])
    return found.withColumns({"ic": rounded(C("ic")), "ir": rounded(C("ir"))})


FRAME60 = "OVER (ORDER BY code, date ROWS 59 PRECEDING)"


def _frame_corr(x: str) -> str:
    flat = " AND ".join(f"min({c}) {FRAME60} < max({c}) {FRAME60}" for c in (x, "target"))
    return f"CASE WHEN count({x}) {FRAME60} = 60 AND count(target) {FRAME60} = 60 AND {flat} THEN covar_pop({x}, target) {FRAME60} / (stddev_pop({x}) {FRAME60} * stddev_pop(target) {FRAME60}) END AS c_{x}"


@query("factor_screen_frame", *FEATS, f"wide AS (SELECT {', '.join(_frame_corr(f) for f in ('f1', 'f2', 'f3'))} FROM alive)", "long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS factor, c_{f} AS c FROM wide" for f in ("f1", "f2", "f3")) + ")",
       f"SELECT factor, {S.r('avg(c)')} AS ic, {S.r('avg(c) / (stddev_samp(c) + 1e-9)')} AS ir, abs(avg(c)) > 0.01 AS selected FROM long GROUP BY factor")
def _(spark, sf_dir):
    found = evaluate.factor_screen(features(spark, sf_dir), ["f1", "f2", "f3"], order=("code", "date"), block=4096)
    return found.withColumns({"ic": rounded(C("ic")), "ir": rounded(C("ir"))})


PERF = """sums AS (
    SELECT count(*) AS days, pow(product(1 + strategy), 252.0 / count(*)) - 1 AS annual, pow(product(1 + benchmark), 252.0 / count(*)) - 1 AS bench_annual,
           stddev_samp(strategy) * sqrt(252) AS volatility, covar_samp(strategy, benchmark) / (var_samp(benchmark) + 1e-9) AS beta,
           avg(CASE WHEN strategy > 0 THEN 1.0 ELSE 0 END) AS win_rate FROM rets
)"""
PERF_COLUMNS = {
    "annual": "annual", "excess": "annual - bench_annual", "volatility": "volatility", "sharpe": "(annual - 0.03) / (volatility + 1e-9)",
    "max_drawdown": "(SELECT max((peak - curve) / peak) FROM curve)", "beta": "beta", "alpha": "annual - (0.03 + beta * (bench_annual - 0.03))", "win_rate": "win_rate",
}


@query("perf_metrics", *FEATS, S.COHORT, PERF, "SELECT days, " + ", ".join(f"CASE WHEN days >= 10 THEN {S.r(x)} END AS {c}" for c, x in PERF_COLUMNS.items()) + " FROM sums")
def _(spark, sf_dir):
    one = evaluate.performance(strategy(spark, sf_dir))
    return one.select("days", *(rounded(C(c)).alias(c) for c in one.columns[1:]))


@query("drawdown", *FEATS, S.COHORT, f"SELECT date, {S.r(S.signed_log('curve'))} AS log_curve, {S.r(S.signed_log('peak'))} AS log_peak, {S.r('(peak - curve) / peak')} AS drawdown FROM curve")
def _(spark, sf_dir):
    found = evaluate.drawdown(strategy(spark, sf_dir))
    return found.select("date", rounded(signed_log(C("curve"))).alias("log_curve"), rounded(signed_log(C("peak"))).alias("log_peak"), rounded(C("drawdown")).alias("drawdown"))


@query("benchmark_returns", S.BARS, "idx AS (SELECT date, avg(close) AS close FROM bars GROUP BY date HAVING date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31')",
       f"SELECT date, {S.r('coalesce(close / lag(close) OVER (ORDER BY date) - 1, 0)')} AS benchmark FROM idx")
def _(spark, sf_dir):
    index = src.index_from_bars(daily(spark, sf_dir))
    found = evaluate.benchmark_returns(index, F.lit("1995-01-01").cast("date"), F.lit("1996-12-31").cast("date"))
    return found.select("date", rounded(C("benchmark")).alias("benchmark"))


@query("regime", *FEATS, "sums AS (SELECT date, avg(CASE WHEN f1 > 0 THEN 1.0 ELSE 0 END) AS up, median(f1) AS med FROM alive GROUP BY date)",
       f"SELECT date, {S.r('up')} AS up_share, {S.r('med')} AS median, CASE WHEN up < 0.4 OR med < -0.02 THEN 'Bear' WHEN up > 0.6 THEN 'Bull' ELSE 'Shock' END AS regime FROM sums")
def _(spark, sf_dir):
    found = evaluate.regime(features(spark, sf_dir), "f1")
    return found.select("date", rounded(C("up_share")).alias("up_share"), rounded(C("median")).alias("median"), "regime")


@query("hybrid_loss", *FEATS, f"SELECT code, {S.r('CASE WHEN count(*) > 1 AND min(score) < max(score) AND min(label) < max(label) THEN 1 - corr(score, label) ELSE 0 END + CASE WHEN count(*) > 1 AND min(score) < max(score) AND min(label) < max(label) THEN 0.5 ELSE 1 END * avg(pow(score - label, 2))')} AS loss FROM predictions GROUP BY code")
def _(spark, sf_dir):
    return evaluate.hybrid_loss(predictions(spark, sf_dir), "code").withColumn("loss", rounded(C("loss")))


@query("last_value", S.BARS, S.FUNDAMENTALS, ASOF, f"SELECT code, {S.r('arg_max_null(pe_ttm, date)')} AS pe_ttm FROM joined GROUP BY code")
def _(spark, sf_dir):
    joined = panel.asof_fundamentals(daily(spark, sf_dir), reports(spark, sf_dir))
    return evaluate.last_value(joined, "pe_ttm").withColumn("pe_ttm", rounded(C("pe_ttm")))


# Picks, samples, portfolio

@query("composite_score", *FEATS, f"{row_sql(score='score', label='label')} FROM predictions")
def _(spark, sf_dir):
    return keyed(predictions(spark, sf_dir), score=C("score"), label=C("label"))


@query("topk", *FEATS, S.COHORT, f"SELECT date, code, place, {S.r('score')} AS score FROM picks")
def _(spark, sf_dir):
    return score.top_k(predictions(spark, sf_dir)).select("date", "code", "place", rounded(C("score")).alias("score"))


ADVICE = """moods AS (
    SELECT date, CASE WHEN avg(CASE WHEN f1 > 0 THEN 1.0 ELSE 0 END) < 0.4 OR median(f1) < -0.02 THEN 'Bear' ELSE 'Other' END AS mood FROM alive GROUP BY date
),
told AS (SELECT p.*, mood, pe_ttm AS ratio FROM picks p JOIN moods USING (date) JOIN joined USING (code, date))"""


@query("topk_advice", *FEATS, S.COHORT, S.FUNDAMENTALS, ASOF, ADVICE, "SELECT date, code, place, CASE WHEN score < 0.6 THEN 'watch' WHEN mood = 'Bear' THEN 'cautious' ELSE 'buy' END AS advice, "
       "CASE WHEN ratio IS NULL OR ratio = 0 THEN '-' ELSE format('{:.2f}', ratio) END AS pe FROM told")  # fmt: skip
def _(spark, sf_dir):
    rows = materialise(predictions(spark, sf_dir).select("code", "date", "score", "f1"))  # read for the picks and for the moods
    moods = evaluate.regime(rows, "f1").select("date", "regime")
    ratios = panel.asof_fundamentals(daily(spark, sf_dir), reports(spark, sf_dir)).select("code", "date", "pe_ttm")
    picks = score.top_k(rows).join(moods, "date").join(ratios, ["code", "date"])
    return score.advice(picks).select("date", "code", "place", "advice", "pe")


@query("last_n", S.BARS, f"{row_sql(close='close')} FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS k FROM bars) WHERE k <= 250")
def _(spark, sf_dir):
    return keyed(score.last_n(daily(spark, sf_dir), 250), close=C("close"))


F3 = ["f1", "f2", "f3"]
SUM30 = "sum(CAST(f1 AS FLOAT)::DOUBLE + CAST(f2 AS FLOAT)::DOUBLE + CAST(f3 AS FLOAT)::DOUBLE) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)"
WINDOWS = (
    f"labelled AS (SELECT *, {S.cs_rank('target')} AS rank_label FROM alive)",
    f"wins AS (SELECT code, date AS start_date, lead(date, 29) OVER {S.W} AS end_date, {SUM30} AS total, coalesce(lead(rank_label, 29) OVER {S.W}, 0.5) AS label, "
    f"row_number() OVER {S.W} - 1 AS i, count(*) OVER (PARTITION BY code) AS n FROM labelled)",
)


def _digest(windows: DataFrame, *more: str) -> DataFrame:
    total = F.aggregate(F.flatten("past_values"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return windows.select("code", "start_date", "end_date", F.size("past_values").cast("long").alias("bars"), rounded(total, 3).alias("total"), *more)


def _training(spark, sf_dir):
    return samples.training_windows(labels.date_labels(features(spark, sf_dir)), F3)


TRAINING = "n > 30 AND i % 5 = 0 AND i + 30 <= n"


@query("window_samples", *FEATS, *WINDOWS, f"SELECT code, start_date, end_date, 30::BIGINT AS bars, {S.r('total', 3)} AS total, {S.r('label')} AS label FROM wins WHERE {TRAINING}")
def _(spark, sf_dir):
    return _digest(_training(spark, sf_dir).withColumn("label", rounded(C("label"))), "label")


@query("batch_score", *FEATS, *WINDOWS, f"SELECT code, end_date, {S.r('total / 90', 4)} AS score FROM wins WHERE {TRAINING}")
def _(spark, sf_dir):
    scored = score.batch_score(_training(spark, sf_dir), lambda windows: windows.astype("float64").mean(axis=(1, 2)), batch=128)
    return scored.select("code", "end_date", rounded(C("score"), 4).alias("score"))


CENTRED = ", ".join(f"covar_pop({a}, {b}) AS {a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz", "xl", "yl", "zl"))
LINEAR = (
    f"tips AS (SELECT code, end_date, label AS l, {', '.join(f'CAST(CAST(lead({f}, 29) OVER {S.W} AS FLOAT) AS DOUBLE) AS {x}' for f, x in (('f1', 'x'), ('f2', 'y'), ('f3', 'z')))}, i, n "
    f"FROM (SELECT a.*, w.end_date, w.label, w.i, w.n FROM alive a JOIN wins w ON w.code = a.code AND w.start_date = a.date))",
    "days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM alive))",
    f"cov AS (SELECT {CENTRED}, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(l) AS ml FROM tips WHERE n > 30 AND i % 5 = 0 AND i + 30 <= n AND end_date < (SELECT date FROM days WHERE k = floor(n * 0.9)))",
    # the three normal equations by determinants
    "det AS (SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS d FROM cov)",
    "fit AS (SELECT *, (xl * (yy * zz - yz * yz) - xy * (yl * zz - yz * zl) + xz * (yl * yz - yy * zl)) / d AS b1, (xx * (yl * zz - yz * zl) - xl * (xy * zz - yz * xz) + xz * (xy * zl - yl * xz)) / d AS b2, "
    "(xx * (yy * zl - yl * yz) - xy * (xy * zl - yl * xz) + xl * (xy * yz - yy * xz)) / d AS b3 FROM det)",
)


@query("linear_score", *FEATS, *WINDOWS, *LINEAR, f"SELECT code, end_date, {S.r('ml + b1 * (x - mx) + b2 * (y - my) + b3 * (z - mz)')} AS score FROM tips, fit WHERE {TRAINING}")
def _(spark, sf_dir):
    """Least squares on the training part, scores of all windows."""
    rows = materialise(labels.date_labels(features(spark, sf_dir)))
    windows = materialise(samples.date_split(samples.training_windows(rows, F3), rows))
    model = linear.fit_linear(windows.where(C("split") == "train"), linear.last_bar())
    return model.score(windows, linear.last_bar()).withColumn("score", rounded(C("score")))


@query("shuffled_samples", *FEATS, *WINDOWS, f"SELECT code, start_date, end_date, {S.r('label')} AS label FROM wins WHERE {TRAINING}")
def _(spark, sf_dir):
    return samples.shuffled(_training(spark, sf_dir), 7).select("code", "start_date", "end_date", rounded(C("label")).alias("label"))


@query("date_split", *FEATS, *WINDOWS, "days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM alive))",
       f"SELECT code, start_date, end_date, CASE WHEN end_date < (SELECT date FROM days WHERE k = floor(n * 0.9)) THEN 'train' ELSE 'test' END AS split FROM wins WHERE {TRAINING}")
def _(spark, sf_dir):
    return samples.date_split(_training(spark, sf_dir), features(spark, sf_dir)).select("code", "start_date", "end_date", "split")


@query("dense_windows", *FEATS, *WINDOWS, f"SELECT code, start_date, end_date, 30::BIGINT AS bars, {S.r('total', 3)} AS total FROM wins WHERE i + 30 <= n AND end_date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'")
def _(spark, sf_dir):
    return _digest(samples.dense_windows(features(spark, sf_dir), F3, F.lit("1997-01-01").cast("date"), F.lit("1997-06-30").cast("date")))


@query("latest_windows", *FEATS, *WINDOWS, f"SELECT code, start_date, end_date, 30::BIGINT AS bars, {S.r('total', 3)} AS total FROM wins WHERE i + 30 = n AND end_date = (SELECT max(date) FROM alive)")
def _(spark, sf_dir):
    return _digest(samples.latest_windows(features(spark, sf_dir), F3))


TICKS = """ticks AS (
    SELECT event_type AS code, time_bucket(INTERVAL 5 MINUTE, ts) AS date, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
           arg_max(value, row(ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2
)"""


@query("intraday_bars", TICKS, f"SELECT code, date AS ts, {S.r('open')} AS open, {S.r('high')} AS high, {S.r('low')} AS low, {S.r('close')} AS close, volume FROM ticks")
def _(spark, sf_dir):
    bars = bars_of_events(src.table(spark, sf_dir, "events"))
    return bars.select("code", C("ts").cast("timestamp_ntz").alias("ts"), *(rounded(C(c)).alias(c) for c in PROFILE[:4]), "volume")


@query("intraday_grains", " UNION ALL ".join(
    f"SELECT event_type AS code, {g} AS grain, time_bucket(INTERVAL {g} MINUTE, ts) AS ts, {S.r('arg_min(value, row(ts, event_id))')} AS open, {S.r('max(value)')} AS high, {S.r('min(value)')} AS low, "
    f"{S.r('arg_max(value, row(ts, event_id))')} AS close, count(*) AS volume FROM (SELECT event_type, value, event_id, ts FROM events) GROUP BY 1, 3" for g in src.GRAINS))  # fmt: skip
def _(spark, sf_dir):
    bars = all_grains(src.table(spark, sf_dir, "events"))
    return bars.select("code", "grain", C("ts").cast("timestamp_ntz").alias("ts"), *(rounded(C(c)).alias(c) for c in PROFILE[:4]), "volume")


@query("intraday_scan", "rare AS (SELECT event_type AS code, time_bucket(INTERVAL 30 MINUTE, ts) AS ts, max(value) AS high, count(*) AS volume FROM events GROUP BY 1, 2)",
       f"SELECT code, ts, {S.r('high')} AS high, volume FROM (SELECT *, count(*) OVER (PARTITION BY code) AS n FROM rare) WHERE n >= 100")
def _(spark, sf_dir):
    """Bars of 30 minutes from files of their own, beside files of 60 minutes that are not to be read."""
    bars = bars_of_events(src.table(spark, sf_dir, "events"), 30).withColumn("date", C("ts"))
    path = code_folder(spark, bars, "_30m.parquet")
    src.write_code_files(bars_of_events(src.table(spark, sf_dir, "events"), 60).withColumn("date", C("ts")), path, "_60m.parquet")
    return src.read_intraday(spark, path, 30).select("code", C("ts").cast("timestamp_ntz").alias("ts"), rounded(C("high")).alias("high"), "volume")


@query("intraday_windows", TICKS, f"aimed AS (SELECT *, {S.lag('close', -5)} / close - 1 AS target FROM ticks)",
       f"wins AS (SELECT code, date AS start_ts, lead(date, 29) OVER {S.W} AS end_ts, lead(target, 29) OVER {S.W} AS label, row_number() OVER {S.W} - 1 AS i, count(*) OVER (PARTITION BY code) AS n FROM aimed WHERE target IS NOT NULL)",
       f"SELECT code, start_ts, end_ts, {S.r('label')} AS label FROM wins WHERE i % 5 = 0 AND i < n - 30")
def _(spark, sf_dir):
    bars = bars_of_events(src.table(spark, sf_dir, "events")).withColumnRenamed("ts", "date")
    bars = labels.simple_target(src.min_history(bars, 99)).na.drop(subset=["target"])
    found = samples.intraday_windows(bars, ["open", "close"])
    return found.select("code", C("start_date").cast("timestamp_ntz").alias("start_ts"), C("end_date").cast("timestamp_ntz").alias("end_ts"), rounded(C("label")).alias("label"))


@query("trade_cost", "SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS part, floor((CASE WHEN l_returnflag = 'R' THEN greatest(l_extendedprice * 100 * 0.0003, 5) + l_extendedprice * 100 * 0.0005 "
       "ELSE greatest(l_extendedprice * 100 * 0.0003, 5) END) * 1e4 + 0.414213562373) / 1e4 AS cost FROM lineitem")  # fmt: skip
def _(spark, sf_dir):
    trades = src.table(spark, sf_dir, "lineitem")
    size = F.when(C("l_returnflag") == "R", -100 * C("l_quantity")).otherwise(100 * C("l_quantity"))
    cost = portfolio.trade_cost(size, C("l_extendedprice") / C("l_quantity"))
    return trades.select(C("l_orderkey").alias("k"), C("l_linenumber").alias("line"), C("l_partkey").alias("part"), rounded(cost, 4).alias("cost"))


LOT = "floor(1e6 / 5 * 0.98 / (close / 100) / 100) * 100"


@query("lot_size_cap", S.BARS, f"SELECT code, date, CAST(CASE WHEN {LOT} < 100 THEN 0 WHEN {LOT} > volume * 100 * 0.02 THEN floor(volume * 100 * 0.02 / 100) * 100 ELSE {LOT} END AS BIGINT) AS size FROM bars")
def _(spark, sf_dir):
    size = portfolio.lot_size(F.lit(1e6), F.lit(5), C("close") / 100, C("volume"))
    return daily(spark, sf_dir).select("code", "date", size.alias("size"))


COST = "(greatest(2e5 * 0.0003, 5) + greatest(2e5 * (1 + target) * 0.0003, 5) + 2e5 * (1 + target) * 0.0005) / 2e5"


@query("cohort_return", *FEATS, S.COHORT, f"SELECT date, {S.r('avg(target)')} AS gross, {S.r(f'avg(target - {COST})')} AS net, count(*) AS n FROM picks GROUP BY date")
def _(spark, sf_dir):
    found = portfolio.cohort_returns(predictions(spark, sf_dir))
    return found.select("date", rounded(C("gross")).alias("gross"), rounded(C("net")).alias("net"), "n")


@query("portfolio_returns", *FEATS, S.COHORT, f"SELECT date, {S.r(S.signed_log('1e6 * curve'))} AS log_value, {S.r('1e6 * curve / coalesce(lag(1e6 * curve) OVER (ORDER BY date), 1e6) - 1')} AS ret FROM curve")
def _(spark, sf_dir):
    values = evaluate.drawdown(strategy(spark, sf_dir)).select("date", (1e6 * C("curve")).alias("value"))
    return portfolio.portfolio_returns(values).select("date", rounded(signed_log(C("value"))).alias("log_value"), rounded(C("ret")).alias("ret"))


@query("portfolio_summary", *FEATS, S.COHORT, f"SELECT {S.r(S.signed_log('arg_max(1e6 * curve, date)'))} AS log_final, {S.r(S.signed_log('arg_max(curve, date) - 1'))} AS log_profit FROM curve")
def _(spark, sf_dir):
    values = evaluate.drawdown(strategy(spark, sf_dir)).select("date", (1e6 * C("curve")).alias("value"))
    return portfolio.portfolio_summary(values).select(rounded(signed_log(C("final_value"))).alias("log_final"), rounded(signed_log(C("profit_rate"))).alias("log_profit"))


@query("trade_summary", *FEATS, S.COHORT, f"SELECT count(target) AS closed, count(*) FILTER (target > 0) AS won, {S.r('count(*) FILTER (target > 0) / count(target)')} AS win_share, {S.r('sum(target)', 4)} AS total_profit FROM picks")
def _(spark, sf_dir):
    one = portfolio.trade_summary(score.top_k(predictions(spark, sf_dir)), "target")
    return one.select("closed", "won", rounded(C("win_share")).alias("win_share"), rounded(C("total_profit"), 4).alias("total_profit"))
