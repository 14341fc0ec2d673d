"""Pieces of SQL from which the oracle texts are put together."""

from __future__ import annotations

BARS = """bars AS (
    SELECT CAST(l_suppkey AS VARCHAR) AS code, CAST(l_shipdate AS DATE) AS date,
           arg_min(p * (1 - l_discount), k) AS open, max(p * (1 + l_tax)) AS high, min(p * (1 - l_discount - l_tax)) AS low,
           arg_max(p * (1 - l_tax), k) AS close, sum(l_quantity) AS volume
    FROM (SELECT *, l_extendedprice / l_quantity AS p, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS k FROM lineitem)
    GROUP BY 1, 2
)"""
FUNDAMENTALS = """quarters AS (
    SELECT CAST(l_suppkey AS VARCHAR) AS code, last_day(date_trunc('quarter', CAST(l_shipdate AS DATE)) + INTERVAL 2 MONTH) AS date,
           100 * avg(l_discount) AS roe, sum(l_extendedprice) AS revenue, sum(l_extendedprice * (1 - l_discount)) AS profit,
           100 * avg(l_tax) AS debt_ratio, avg(l_extendedprice) / sum(l_quantity) AS pe_ttm, avg(l_quantity) AS pb
    FROM lineitem GROUP BY 1, 2
),
fundamentals AS (
    SELECT code, date, roe, revenue / lag(revenue) OVER w - 1 AS rev_growth, profit / lag(profit) OVER w - 1 AS profit_growth, debt_ratio, pe_ttm, pb
    FROM quarters WINDOW w AS (PARTITION BY code ORDER BY date)
)"""
W = "(PARTITION BY code ORDER BY date)"
SO_FAR = "(PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def r(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.414213562373) / 1e{digits}"


def signed_log(x: str) -> str:
    return f"sign({x}) * ln(1 + abs({x}))"


def frame(n: int) -> str:
    return f"(PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(n: int, value: str, *series: str) -> str:
    return "CASE WHEN " + " AND ".join(f"count({x}) OVER {frame(n)} = {n}" for x in series) + f" THEN {value} END"


def agg(name: str, x: str, n: int) -> str:
    return full(n, f"{name}({x}) OVER {frame(n)}", x)


def lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) OVER {W}" if k >= 0 else f"lead({x}, {-k}) OVER {W}"


def corr(x: str, y: str, n: int) -> str:
    f = frame(n)
    moving = f"min({x}) OVER {f} < max({x}) OVER {f} AND min({y}) OVER {f} < max({y}) OVER {f}"
    return full(n, f"CASE WHEN {moving} THEN covar_pop({x}, {y}) OVER {f} / (stddev_pop({x}) OVER {f} * stddev_pop({y}) OVER {f}) END", x, y)


def moment(name: str, x: str, n: int) -> str:
    f = frame(n)
    return full(n, f"CASE WHEN min({x}) OVER {f} < max({x}) OVER {f} THEN {name}({x}) OVER {f} END", x)


def ts_rank(x: str, n: int) -> str:
    a = f"list({x}) OVER {frame(n)}"
    return full(n, f"(len(list_filter({a}, lambda v: v < {x})) + (len(list_filter({a}, lambda v: v = {x})) - 1) / 2.0) / {n - 1}", x)


def decay(x: str, n: int) -> str:
    terms = " + ".join(f"lag({x}, {n - k}) OVER {W} * {k}" if k < n else f"{x} * {n}" for k in range(1, n + 1))
    return full(n, f"({terms}) / {n * (n + 1) / 2}", x)


def zscore(x: str, n: int) -> str:
    return full(n, f"({x} - avg({x}) OVER {frame(n)}) / (stddev_samp({x}) OVER {frame(n)} + 1e-9)", x)


def normal(x: str, n: int = 60, limit: int = 4) -> str:
    """For a series without NULL."""
    z = zscore(x, n)
    return f"CASE WHEN count({x}) OVER {frame(n)} = {n} THEN least(greatest({z}, -{limit}), {limit}) ELSE 0 END"


def cs_rank(x: str) -> str:
    rank = f"rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0"
    return f"CASE WHEN {x} IS NOT NULL THEN ({rank}) / count({x}) OVER (PARTITION BY date) END"


def ewm(name: str, source: str, columns: dict[str, tuple[str, float, bool]]) -> str:
    """Recursive table ``name``: code, date and exponentially weighted means of columns of ``source`` (none NULL)."""
    start = ", ".join(f"{x} AS {c}, 1.0::DOUBLE AS {c}_w" for c, (x, _, _) in columns.items())
    step = ", ".join(
        f"(e.{c} * e.{c}_w * {1 - a} + s.{x}) / (e.{c}_w * {1 - a} + 1), e.{c}_w * {1 - a} + 1" if adjust else f"e.{c} * {1 - a} + s.{x} * {a}, 1.0::DOUBLE"
        for c, (x, a, adjust) in columns.items()
    )
    return f"""{name}_n AS (SELECT *, row_number() OVER {W} AS k FROM {source}),
{name} AS (
    SELECT code, date, k, {start} FROM {name}_n WHERE k = 1
    UNION ALL
    SELECT s.code, s.date, s.k, {step} FROM {name} e JOIN {name}_n s ON s.code = e.code AND s.k = e.k + 1
)"""


BASE = f"""base AS (
    SELECT *, close / {lag("close", 1)} - 1 AS r, ln(close / {lag("close", 1)}) AS lr, close - {lag("close", 1)} AS dc, {lag("close", 1)} AS prev,
           {agg("avg", "close", 20)} AS ma20, {agg("stddev_samp", "close", 20)} AS sd20,
           {agg("min", "low", 9)} AS low9, {agg("max", "high", 9)} AS high9,
           ((close - low) - (high - close)) / (high - low + 1e-9) * volume AS clv, (high - low) / close AS spread,
           ln(high / low) AS log_hl, ln(close / open) AS log_co, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs
    FROM bars
),
derived AS (
    SELECT *, {lag("r", 1)} AS r1, {lag("dc", 1)} AS dc1, CASE WHEN dc > 0 THEN dc ELSE 0 END AS up, CASE WHEN dc < 0 THEN -dc ELSE 0 END AS down,
           CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END AS rises, CASE WHEN r > 0 THEN 0.0::DOUBLE ELSE r END AS loss, abs(dc) AS abs_dc,
           {agg("stddev_samp", "r", 5)} AS sd5, ln(open / prev) AS log_oc, (close - low9) / (high9 - low9 + 1e-9) * 100 AS rsv
    FROM base
)"""
#: Rows with enough history, three rounded features, their composite score, target and labels.
PREDICTIONS = f"""feats AS (
    SELECT *, round({agg("sum", "lr", 20)}, 9) AS f1, round({agg("stddev_samp", "r", 20)}, 9) AS f2, round(ln({agg("sum", "volume", 20)} + 1), 9) AS f3,
           {lag("close", -5)} / {lag("open", -1)} - 1 AS target
    FROM derived
),
alive AS (SELECT * FROM feats WHERE f1 IS NOT NULL AND target IS NOT NULL),
ranked AS (SELECT *, ({cs_rank("f1")} - 0.5) * 2 AS cs_rank_f1, ({cs_rank("f2")} - 0.5) * 2 AS cs_rank_f2, ({cs_rank("f3")} - 0.5) * 2 AS cs_rank_f3 FROM alive),
predictions AS (
    SELECT *, round((cs_rank_f1 + cs_rank_f2 + cs_rank_f3) / 3, 9) AS score, round((target - avg(target) OVER (PARTITION BY date)) / 100, 9) AS label FROM ranked
)"""
LAYERS = """edges AS (SELECT date, quantile_cont(score, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM predictions GROUP BY date),
layers AS (
    SELECT date, layer, avg(label) AS label, count(*) AS n
    FROM (SELECT p.date, p.label, CAST(greatest(len(list_filter(list_distinct(list_transform(e, lambda y: round(y, 12))), lambda x: x < round(p.score, 12))) - 1, 0) AS BIGINT) AS layer
          FROM predictions p JOIN edges ON edges.date = p.date)
    GROUP BY date, layer
),
wide AS (SELECT date, """ + ", ".join(f"max(label) FILTER (layer = {k}) AS layer_{k}" for k in range(5)) + """ FROM layers GROUP BY date)"""
COHORT = """placed AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS place FROM predictions),
picks AS (SELECT * FROM placed WHERE place <= 5),
idx AS (SELECT date, avg(close) AS close FROM bars GROUP BY date),
bench AS (SELECT date, coalesce(close / lag(close) OVER (ORDER BY date) - 1, 0) AS benchmark FROM idx),
strat AS (SELECT date, avg(target) / 100 AS strategy FROM picks GROUP BY date),
rets AS (SELECT date, strategy, benchmark FROM strat JOIN bench USING (date)),
curve AS (
    SELECT date, curve, max(curve) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak
    FROM (SELECT date, product(1 + strategy) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS curve FROM rets)
)"""


def chain(*parts: str) -> str:
    return "WITH " + ("RECURSIVE " if any("UNION ALL" in p for p in parts) else "") + ",\n".join(parts) + "\n"
