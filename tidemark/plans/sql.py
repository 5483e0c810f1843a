"""DuckDB SQL of the queries, built from shared common table expressions."""

from __future__ import annotations

import math

from .market import BRANDS, GARCH, LAMBDA, MIXTURE, PIVOT, SLICE

LINE = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
OHLCV = "arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(v)::DOUBLE AS volume"
LINES = f"SELECT {{t}} AS ticker, l_shipdate::DATE AS ts, l_extendedprice / l_quantity AS px, l_quantity AS v, {LINE} AS k FROM lineitem"

daily = f"bars AS (SELECT ticker, ts, {OHLCV} FROM ({LINES.format(t="'ALL'")} WHERE l_quantity > 0) GROUP BY ALL)"
brand = f"bars AS (SELECT ticker, ts, {OHLCV} FROM ({LINES.format(t='p_brand')} JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0) GROUP BY ALL)"
segment = f"bars AS (SELECT ticker, ts, {OHLCV} FROM (SELECT c_mktsegment AS ticker, o_orderdate::DATE AS ts, o_totalprice AS px, 1.0::DOUBLE AS v, o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY ALL)"
hourly = f"bars AS (SELECT ticker, ts, {OHLCV} FROM (SELECT 'ALL' AS ticker, date_trunc('hour', ts)::TIMESTAMP AS ts, value AS px, 1.0::DOUBLE AS v, row(ts, event_id) AS k FROM events) GROUP BY ALL)"

W = "(PARTITION BY ticker ORDER BY ts)"


def frame(a: str, b: str) -> str:
    return f"(PARTITION BY ticker ORDER BY ts ROWS BETWEEN {a} AND {b})"


def upto(n: int) -> str:
    return frame(f"{n - 1} PRECEDING", "CURRENT ROW")


def before(n: int) -> str:
    return frame(f"{n} PRECEDING", "1 PRECEDING")


def after(n: int) -> str:
    return frame("1 FOLLOWING", f"{n} FOLLOWING")


def full(value: str, x: str, over: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {over} >= {n} THEN {value} END"


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) AS {name}"


lr = f"lr AS (SELECT *, CASE WHEN close / nullif(lag(close) OVER {W}, 0) > 0 THEN ln(close / lag(close) OVER {W}) END AS lr FROM bars)"
rv = f"rv AS (SELECT *, {full(f'stddev_samp(lr) OVER {upto(22)} * sqrt(252.0) * 100', 'lr', upto(22), 22)} AS rv22 FROM lr)"
pat = f"""abc AS (SELECT *, lag(lr, 2) OVER {W} AS a, lag(lr, 1) OVER {W} AS b, lr AS c, row_number() OVER {W} AS rn FROM {{src}}),
pat AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN NULL WHEN a <= b AND b <= c THEN 0 WHEN a <= c AND c < b THEN 1 WHEN b < a AND a <= c THEN 2 WHEN c < a AND a <= b THEN 4 WHEN b <= c AND c < a THEN 3 ELSE 5 END AS k,
  (pow(a - (a + b + c) / 3, 2) + pow(b - (a + b + c) / 3, 2) + pow(c - (a + b + c) / 3, 2)) / 3 AS wt FROM abc)"""
_sum = ", ".join(f"coalesce(sum(wt) FILTER (WHERE k = {k}) OVER {frame('20 PRECEDING', '1 PRECEDING')}, 0) AS s{k}" for k in range(6))
_ent = lambda e: " + ".join(f"(CASE WHEN {e(k)} > 0 THEN -({e(k)}) * ln({e(k)}) ELSE 0 END)" for k in range(6))
_u = 1 / 6
_su = math.log(6)
_q0 = 1 / (-((1 + _u) / 2) * math.log((1 + _u) / 2) - 5 * (_u / 2) * math.log(_u / 2) - 0.5 * _su)
_wpe = f"""sums AS (SELECT *, {_sum}, count(lr) OVER {before(22)} AS seen FROM pat),
tot AS (SELECT *, CASE WHEN rn > 22 AND seen >= 3 AND s0 + s1 + s2 + s3 + s4 + s5 > 0 THEN s0 + s1 + s2 + s3 + s4 + s5 END AS total FROM sums),
ent AS (SELECT *, CASE WHEN total IS NOT NULL THEN {_ent(lambda k: f's{k} / total')} END AS sp, CASE WHEN total IS NOT NULL THEN {_ent(lambda k: f'(s{k} / total + {_u!r}) / 2')} END AS sm FROM tot),
wpe0 AS (SELECT *, sp / {_su!r} AS wpe FROM ent),
wpe AS (SELECT *, {_q0!r} * (sm - 0.5 * sp - 0.5 * {_su!r}) * wpe AS complexity FROM wpe0)"""


def wpe(src: str = "rv") -> str:
    return ", ".join(([lr, rv] if src == "rv" else [lr]) + [pat.format(src=src), _wpe])


DW = f"{daily}, {wpe()}"
forward = ", ".join(
    [full(f"stddev_samp(lr) OVER {after(h)} * sqrt(252.0) * 100", "lr", after(h), h) + f" AS fv{h}" for h in (5, 10, 20)]
    + [full(f"(min(close) OVER {after(h)} / nullif(close, 0) - 1) * 100", "close", after(h), h) + f" AS fdd{h}" for h in (5, 10, 20)]
    + [full(f"abs(least(0, (close - max(close) OVER {frame('CURRENT ROW', '9 FOLLOWING')}) / nullif(close, 0) * 100))", "close", frame("CURRENT ROW", "9 FOLLOWING"), 10) + " AS runup10"]
)
labelled = f"""{DW}, fw AS (SELECT *, {forward} FROM wpe), lab AS (SELECT *, ntile(3) OVER (PARTITION BY ticker ORDER BY round(wpe, 9), ts) - 1 AS label FROM fw WHERE wpe IS NOT NULL),
reg AS (SELECT *, CASE label WHEN 0 THEN 'Deterministic' WHEN 1 THEN 'Transitional' ELSE 'Stochastic' END AS regime FROM lab)"""
volume = f"""lv AS (SELECT *, ln(1 + greatest(volume, 0)) AS lv FROM {{src}}), vz AS (SELECT *,
  CASE WHEN coalesce(stddev_samp(lv) OVER (PARTITION BY ticker), 0) > 0 THEN (lv - avg(lv) OVER (PARTITION BY ticker)) / stddev_samp(lv) OVER (PARTITION BY ticker) ELSE 0 END AS vol_global_z,
  (lv - avg(lv) OVER {upto(252)}) / nullif(stddev_samp(lv) OVER {upto(252)}, 0) AS vol_rolling_z FROM lv)"""


def sample_entropy(src: str, x: str, radius: str, window: int = 60) -> str:
    """CTE ``se`` (ticker, ts, se): SampEn(2) by a range self-join inside each window."""
    return f"""pts AS (SELECT ticker, ts, {x} AS x, row_number() OVER {W} AS rn, lead({x}, 1) OVER {W} AS x1, lead({x}, 2) OVER {W} AS x2, {radius} AS r FROM {src}),
pairs AS (SELECT t.ticker, t.ts, count(*) AS b, count(*) FILTER (WHERE abs(i.x2 - j.x2) <= t.r) AS a FROM pts t
  JOIN pts i ON i.ticker = t.ticker AND i.rn BETWEEN t.rn - {window} AND t.rn - 4
  JOIN pts j ON j.ticker = t.ticker AND j.rn > i.rn AND j.rn <= t.rn - 3 AND abs(i.x - j.x) <= t.r AND abs(i.x1 - j.x1) <= t.r
  WHERE t.rn > {window} AND t.r > 0 GROUP BY ALL),
se AS (SELECT p.ticker, p.ts, CASE WHEN a > 0 AND b > 0 THEN -ln(a / b::DOUBLE) END AS se FROM pts p LEFT JOIN pairs USING (ticker, ts))"""


price_se = f"{daily}, {sample_entropy('bars', 'close', f'0.2 * stddev_pop(close) OVER {before(60)}')}"
basket = f"""{segment}, days AS (SELECT DISTINCT ts FROM bars), names AS (SELECT DISTINCT ticker FROM bars),
panel AS (SELECT n.ticker, d.ts, last_value(b.close IGNORE NULLS) OVER (PARTITION BY n.ticker ORDER BY d.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM days d CROSS JOIN names n LEFT JOIN bars b ON b.ts = d.ts AND b.ticker = n.ticker),
ret0 AS (SELECT ticker, ts, close / lag(close) OVER {W} - 1 AS ret FROM panel), ret AS (SELECT * FROM ret0 WHERE ts IN (SELECT ts FROM ret0 WHERE ret IS NOT NULL))"""
_pair = "(PARTITION BY a, b ORDER BY ts ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING)"
# from sums, as a window of pairs: Spark's corr adds in another order, so six decimals are compared
corr = f"""{basket}, pr AS (SELECT x.ts, x.ticker AS a, y.ticker AS b, x.ret AS x, y.ret AS y FROM ret x JOIN ret y ON x.ts = y.ts AND x.ticker < y.ticker WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL),
cr0 AS (SELECT ts, a, b, corr(x, y) OVER {_pair} AS r, count(*) OVER {_pair} AS n, min(x) OVER {_pair} = max(x) OVER {_pair} AS fa, min(y) OVER {_pair} = max(y) OVER {_pair} AS fb FROM pr),
cr AS (SELECT ts, a, b, CASE WHEN isfinite(r) AND NOT fa AND NOT fb THEN r END AS r, n, fa, fb FROM cr0)"""
two = f"""{corr}, p2 AS (SELECT ts, (1 + r) / 2 AS p, (1 - r) / 2 AS q, fa, fb FROM cr WHERE n = 22 AND a = 'AUTOMOBILE' AND b = 'BUILDING'),
cse AS (SELECT 'ALL' AS ticker, ts, CASE WHEN fa AND fb THEN NULL WHEN fa OR fb THEN 0 WHEN p IS NOT NULL THEN -((CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) + (CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END)) / ln(2.0) * 100 END AS cse FROM p2)"""


def _log(c: dict) -> str:
    det = c["sxx"] * c["syy"] - c["sxy"] ** 2
    dx, dy = f"(wpe - {c['mx']!r})", f"(rv22 / 100 - {c['my']!r})"
    return f"(-0.5 * ({dx} * {dx} * {c['syy']!r} - 2 * {dx} * {dy} * {c['sxy']!r} + {dy} * {dy} * {c['sxx']!r}) / {det!r} + {math.log(c['w']) - 0.5 * math.log(det) - math.log(2 * math.pi)!r})"


posterior = f"""{DW}, lg AS (SELECT ticker, ts, {', '.join(f'{_log(c)} AS l{k}' for k, c in enumerate(MIXTURE))} FROM wpe WHERE wpe IS NOT NULL AND rv22 IS NOT NULL),
ex AS (SELECT ticker, ts, {', '.join(f'exp(l{k} - greatest(l0, l1, l2)) AS e{k}' for k in range(3))} FROM lg),
po AS (SELECT ticker, ts, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM ex),
lb AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS top, greatest(p0, p1, p2) AS pt, row_number() OVER {W} AS n FROM po)"""
held = f"""{posterior}, hy AS (
  SELECT n, top AS held, -1 AS pending, 0 AS cnt FROM lb WHERE n = 1
  UNION ALL
  SELECT n, CASE WHEN flip THEN top ELSE old END, CASE WHEN NOT flip AND margin >= 0.2 THEN top ELSE -1 END, CASE WHEN NOT flip AND margin >= 0.2 THEN c ELSE 0 END FROM (
    SELECT *, top = old OR margin >= 0.4 OR (margin >= 0.2 AND c >= 3) AS flip FROM (
      SELECT lb.n, lb.top, hy.held AS old, CASE WHEN hy.pending = lb.top THEN hy.cnt + 1 ELSE 1 END AS c, lb.pt - CASE hy.held WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS margin
      FROM hy JOIN lb ON lb.n = hy.n + 1))
), hl AS (SELECT lb.ticker, lb.ts, lb.top AS raw, hy.held FROM lb JOIN hy USING (n))"""
split = held.replace("row_number() OVER " + W + " AS n FROM po)", f"row_number() OVER {W} AS n, ts >= '{PIVOT}' AND coalesce(lag(ts) OVER {W} < '{PIVOT}', true) AS begins FROM po)").replace(
    "SELECT *, top = old OR margin", "SELECT *, begins OR top = old OR margin").replace("SELECT lb.n, lb.top,", "SELECT lb.n, lb.top, lb.begins,")
assert split.count("begins") == 3
decisions = f"""{brand}, {lr}, sm AS (SELECT *, {full(f'avg(close) OVER {upto(20)}', 'close', upto(20), 20)} AS sma20 FROM lr), {volume.format(src='sm')},
rv AS (SELECT *, {full(f'stddev_samp(lr) OVER {upto(22)} * sqrt(252.0) * 100', 'lr', upto(22), 22)} AS rv22 FROM vz), {pat.format(src='rv')}, {_wpe},
ki0 AS (SELECT *, wpe - lag(wpe) OVER {W} AS v_wpe FROM wpe), ki AS (SELECT *, v_wpe - lag(v_wpe) OVER {W} AS a_wpe FROM ki0),
de0 AS (SELECT *, round(rv22 / 400, 4) AS sigma, coalesce(close > sma20, false) AS above,
  CASE WHEN round(wpe, 9) < 0.85 THEN 'Deterministic' WHEN round(wpe, 9) < 0.92 THEN 'Transitional' ELSE 'Stochastic' END AS regime,
  CASE WHEN round(vol_global_z, 9) < -0.5 THEN 'Erratic/Noisy Flow' WHEN round(vol_global_z, 9) < 0.5 THEN 'Consensus Flow' ELSE 'Dispersed Flow' END AS flow
  FROM ki WHERE wpe IS NOT NULL AND rv22 IS NOT NULL),
de1 AS (SELECT *, CASE regime WHEN 'Stochastic' THEN 1.0 WHEN 'Transitional' THEN 1.4 ELSE 2.2 END::DOUBLE AS price_mult, CASE flow WHEN 'Consensus Flow' THEN 1.0 WHEN 'Dispersed Flow' THEN 1.3 ELSE 1.8 END::DOUBLE AS volume_mult FROM de0),
de AS (SELECT *, greatest(price_mult, volume_mult) AS mult, round(sigma * greatest(price_mult, volume_mult) + 1e-9, 4) AS s FROM de1)"""


def q(with_: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{with_} {select}"


ALL = "ticker, ts, open, high, low, close, volume"
fc = f"""{daily}, {lr}, fc AS (SELECT *, lr * lr AS rv, {full(f'var_samp(lr) OVER {before(22)}', 'lr', before(22), 22)} AS f22, {full(f'var_samp(lr) OVER {before(60)}', 'lr', before(60), 60)} AS f60 FROM lr),
ql AS (SELECT *, greatest(rv, 1e-12) / greatest(f22, 1e-12) AS u22, greatest(rv, 1e-12) / greatest(f60, 1e-12) AS u60 FROM fc)"""
scores = " UNION ALL ".join(f"SELECT ticker, 'f{n}' AS forecast, avg(u{n} - ln(u{n}) - 1) AS qlike, avg((rv - f{n}) * (rv - f{n})) AS mse, corr(rv, f{n}) AS r, corr(sqrt(rv), sqrt(f{n})) AS r_sigma FROM ql WHERE rv IS NOT NULL AND f{n} IS NOT NULL GROUP BY ticker" for n in (22, 60))
stats = " UNION ALL ".join(f"SELECT regime, 'fv{h}' AS measure, count(*) AS n, {r(f'avg(fv{h})', 'mean')}, {r(f'median(fv{h})', 'median')}, {r(f'stddev_samp(fv{h})', 'sd')} FROM reg WHERE fv{h} IS NOT NULL GROUP BY regime" for h in (5, 10, 20))
hits = " UNION ALL ".join(f"SELECT regime, 'fdd{h}' AS measure, {t}::DOUBLE AS threshold, count(*) AS n, {r(f'avg((fdd{h} < {t})::INT)', 'rate')} FROM reg WHERE fdd{h} IS NOT NULL GROUP BY regime" for h in (5, 10, 20) for t in (-5.0, -10.0, -20.0))
_share = lambda h, t, g: f"coalesce(avg((fdd{h} < {t})::INT) FILTER (WHERE regime = '{g}'), 0)"
contrast = " UNION ALL ".join(
    f"SELECT 'fdd{h}' AS measure, {t}::DOUBLE AS threshold, count(*) FILTER (WHERE regime = 'Deterministic') AS n_high, count(*) FILTER (WHERE regime = 'Stochastic') AS n_low, {r(_share(h, t, 'Deterministic'), 'rate_high')}, "
    f"{r(_share(h, t, 'Stochastic'), 'rate_low')}, {r(_share(h, t, 'Deterministic') + ' / nullif(' + _share(h, t, 'Stochastic') + ', 0)', 'lift').replace('round(', 'coalesce(round(', 1).replace(' AS lift', ', 0) AS lift')} FROM whole" for h in (5, 10, 20) for t in (-5.0, -10.0, -20.0))
leads = " UNION ALL ".join(f"SELECT ticker, {k} AS lead, {r(f'corr(wpe, y{k})', 'r')} FROM ll GROUP BY ticker" for k in (0, 5, 10, 20))


def _box(lags: int) -> str:
    cols = ", ".join(f"sum(d * l{k}) AS s{k}" for k in range(1, lags + 1))
    qs = " + ".join(f"pow(s{k} / v, 2) / (n - {k})" for k in range(1, lags + 1))
    tail = " + ".join(f"pow(q / 2, {k}) / {math.factorial(k)}" for k in range(lags // 2))
    lag = ", ".join(f"lag(d, {k}) OVER {W} AS l{k}" for k in range(1, lags + 1))
    return f"SELECT ticker, {r('q', 'q')}, {r(f'least(1.0, exp(-q / 2) * ({tail}))', 'p')}, {lags} AS lags FROM (SELECT ticker, n * (n + 2) * ({qs}) AS q FROM (SELECT ticker, count(*) AS n, sum(d * d) AS v, {cols} FROM (SELECT *, {lag} FROM dv) GROUP BY ticker))"


def _best(states: int) -> float:
    """Entropy halfway between the uniform distribution and a certain state."""
    u = 1 / states
    return -((1 + u) / 2) * math.log((1 + u) / 2) - (states - 1) * (u / 2) * math.log(u / 2)


moments = f"""{labelled}, mo AS (SELECT ((label + 1) % 3)::INT AS cluster, avg(wpe) AS mx, avg(rv22 / 100) AS my, var_pop(wpe) AS sxx, covar_pop(wpe, rv22 / 100) AS sxy, var_pop(rv22 / 100) AS syy FROM reg WHERE rv22 IS NOT NULL GROUP BY 1)"""
ell = f"""{moments}, ax AS (SELECT *, (sxx + syy) / 2 AS mid, sqrt(pow((sxx - syy) / 2, 2) + sxy * sxy) AS half FROM mo),
el AS (SELECT cluster, mx AS cx, my AS cy, 4 * sqrt(mid + half) AS width, 4 * sqrt(greatest(mid - half, 0)) AS height, CASE WHEN sxy = 0 THEN CASE WHEN sxx >= syy THEN 0 ELSE 90 END ELSE degrees(atan2(mid + half - sxx, sxy)) END AS angle FROM ax)"""
_levels = "CASE WHEN s >= 2.5 THEN 3 WHEN s >= 1.5 THEN 2 WHEN s >= 0.8 THEN 1 ELSE 0 END"
_code = f"CASE regime WHEN 'Deterministic' THEN ['CALM MARKET', 'STRUCTURAL WARNING', 'HIGH RISK', 'EXTREME RISK'][1 + {_levels}] ELSE ['CALM MARKET', 'MODERATE RISK', 'MODERATE RISK', 'ELEVATED VOLATILITY'][1 + {_levels}] END"
_spec = f"CASE regime WHEN 'Stochastic' THEN ['LOW RISK', 'LOW-MODERATE', 'ELEVATED VOLATILITY', 'ELEVATED VOLATILITY'][1 + {_levels}] WHEN 'Transitional' THEN ['STRUCTURAL BUILD-UP', 'MODERATE RISK', 'HIGH RISK', 'HIGH RISK'][1 + {_levels}] ELSE ['STRUCTURAL WARNING', 'STRUCTURAL WARNING', 'HIGH RISK', 'EXTREME RISK'][1 + {_levels}] END"
_v, _a = "coalesce(round(v_wpe, 9), 0)", "coalesce(round(a_wpe, 9), 0)"
_trend = f"CASE WHEN {_v} > 0.005 THEN 'rising' WHEN {_v} < -0.005 THEN 'falling' ELSE 'stable' END"
_yj = f"CASE WHEN lr >= 0 THEN (pow(lr + 1, {LAMBDA}) - 1) / {LAMBDA} ELSE -(pow(1 - lr, {2 - LAMBDA}) - 1) / {2 - LAMBDA} END"
_exo = f"""{daily}, {lr}, {volume.format(src='lr')}, rv AS (SELECT *, {full(f'stddev_samp(lr) OVER {upto(22)} * sqrt(252.0) * 100', 'lr', upto(22), 22)} AS rv22 FROM vz), {pat.format(src='rv')}, {_wpe},
ok AS (SELECT ticker, ts, close, (wpe + abs(vol_rolling_z)) / 2 AS hp, (complexity + rv22) / 2 AS hv FROM wpe WHERE wpe IS NOT NULL AND vol_rolling_z IS NOT NULL AND complexity IS NOT NULL AND rv22 IS NOT NULL AND close IS NOT NULL)"""


def _scaled(x: str) -> str:
    lo, hi = f"min({x}) OVER {upto(504)}", f"max({x}) OVER {upto(504)}"
    return full(f"least(greatest(({x} - {lo}) / CASE WHEN {hi} = {lo} THEN 1e-8 ELSE {hi} - {lo} END, 0), 1)", x, upto(504), 60)


_exo += f", sc AS (SELECT *, {_scaled('hp')} AS sp, {_scaled('hv')} AS sv FROM ok), lg2 AS (SELECT *, lag(sp) OVER {W} AS h_price, lag(sv) OVER {W} AS h_volume FROM sc), ex2 AS (SELECT * FROM lg2 WHERE h_price IS NOT NULL AND h_volume IS NOT NULL)"
#: Held labels of every brand: the recursion of ``held`` with a row for each ticker.
brands_held = f"{brand}, {held.split(daily + ', ', 1)[1]}".replace("SELECT n, top AS held", "SELECT ticker, n, top AS held").replace("SELECT n, CASE WHEN flip", "SELECT ticker, n, CASE WHEN flip").replace("SELECT lb.n, lb.top,", "SELECT lb.ticker, lb.n, lb.top,").replace("ON lb.n = hy.n + 1", "ON lb.ticker = hy.ticker AND lb.n = hy.n + 1").replace("JOIN hy USING (n)", "JOIN hy USING (ticker, n)")

SQL = {
    "bars_daily": q(daily, f"SELECT {ALL} FROM bars"),
    "bars_by_brand": q(brand, f"SELECT {ALL} FROM bars"),
    "bars_by_segment": q(segment, f"SELECT {ALL} FROM bars"),
    "bars_hourly": q(hourly, f"SELECT {ALL} FROM bars"),
    "stream_bars": q(hourly, f"SELECT {ALL} FROM bars"),
    "date_slice": q(f"{daily.replace('bars AS', 'bars0 AS')}, bars AS (SELECT * FROM bars0 WHERE ts BETWEEN '{SLICE[0]}' AND '{SLICE[1]}'), {lr}", f"SELECT ts, {r('close', 'close')}, {r('lr', 'lr')} FROM lr"),
    "length_guard": q(brand, "SELECT ticker, count(*) AS n_bars, CASE WHEN count(*) >= 504 THEN 'ok' ELSE 'too_short' END AS status FROM bars GROUP BY ticker"),
    "source_fallback": q(daily, f"SELECT ticker, ts, {r('close', 'close')}, {r('volume', 'volume')} FROM bars"),
    "connector_bars": q(brand, f"SELECT {ALL} FROM bars"),
    "connector_slice": q(f"{brand.replace('bars AS', 'bars0 AS')}, bars AS (SELECT * FROM bars0 WHERE ticker IN {tuple(BRANDS)} AND ts BETWEEN '{SLICE[0]}' AND '{SLICE[1]}'), {lr}", f"SELECT ticker, ts, {r('close', 'close')}, {r('lr', 'lr')} FROM lr"),
    "stream_connector": q(brand, f"SELECT {ALL} FROM bars"),
    "ffill_locf": q(basket, f"SELECT ticker, ts, {r('close', 'close')} FROM panel"),
    "basket_returns": q(basket, f"SELECT ts, ticker, {r('ret', 'ret')} FROM ret"),
    "latest_rows": q(f"{brand}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS k FROM bars)", f"SELECT ticker, {r('max(CASE WHEN k = 1 THEN close END)', 'last_close')}, {r('max(CASE WHEN k = 2 THEN close END)', 'previous_close')}, {r('arg_min(close, ts)', 'first_close')} FROM k GROUP BY ticker"),
    "log_returns": q(f"{daily}, {lr}", f"SELECT ts, {r('lr', 'lr')}, {r('coalesce(lr, 0)', 'lr0')} FROM lr"),
    "pct_change": q(daily, f"SELECT ts, {r(f'close / lag(close) OVER {W} - 1', 'ret1')}, {r(f'close / lag(close, 5) OVER {W} - 1', 'ret5')} FROM bars"),
    "sma20": q(f"{daily}, m AS (SELECT *, {full(f'avg(close) OVER {upto(20)}', 'close', upto(20), 20)} AS m FROM bars)", f"SELECT ts, {r('m', 'sma20')}, coalesce(close > m, false) AS above_sma20 FROM m"),
    "rolling_vol22": q(f"{daily}, {lr}, {rv}", f"SELECT ts, {r('rv22', 'rv22')} FROM rv"),
    "rolling_minmax": q(daily, f"SELECT ts, {r(_scaled('volume'), 'scaled')} FROM bars"),
    "rolling_median": q(daily, f"SELECT ts, {r(full(f'median(close) OVER {upto(252)}', 'close', upto(252), 60) + ' + 1e-9', 'med252')} FROM bars"),
    "forward_vol": q(f"{daily}, {lr}, fw AS (SELECT *, {forward} FROM lr)", f"SELECT ts, {', '.join(r(f'fv{h}', f'fv{h}') for h in (5, 10, 20))} FROM fw"),
    "forward_drawdown": q(f"{daily}, {lr}, fw AS (SELECT *, {forward} FROM lr)", f"SELECT ts, {', '.join(r(f'fdd{h}', f'fdd{h}') for h in (5, 10, 20))} FROM fw"),
    "forward_runup": q(f"{daily}, {lr}, fw AS (SELECT *, {forward} FROM lr)", f"SELECT ts, {r('runup10', 'runup10')} FROM fw"),
    "cum_product": q(f"{daily}, {lr}", f"SELECT ts, {r(f'1000.0 * exp(sum(coalesce(lr, 0)) OVER {frame("UNBOUNDED PRECEDING", "CURRENT ROW")})', 'path', 4)} FROM lr"),
    "ordinal_patterns": q(f"{daily}, {lr}, {pat.format(src='lr')}", f"SELECT k AS pattern, count(*) AS n, {r('sum(wt)', 'weight')} FROM pat WHERE k IS NOT NULL GROUP BY k"),
    "price_wpe_mfi": q(DW, f"SELECT ts, {r('wpe', 'wpe')}, {r('complexity', 'complexity')}, {r('wpe * (1 - complexity)', 'mfi')} FROM wpe"),
    "brand_wpe": q(f"{brand}, {wpe('lr')}", f"SELECT ticker, ts, {r('wpe', 'wpe')}, {r('complexity', 'complexity')} FROM wpe"),
    "wpe_kinematics": q(f"{DW}, ki0 AS (SELECT *, wpe - lag(wpe) OVER {W} AS v FROM wpe)", f"SELECT ts, {r('v', 'v_wpe')}, {r(f'v - lag(v) OVER {W}', 'a_wpe')} FROM ki0"),
    "price_sampen": q(price_se, f"SELECT ts, {r('se', 'price_sampen')} FROM se"),
    "spe_z_global": q(price_se, f"SELECT ts, {r('(se - avg(se) OVER ()) / stddev_pop(se) OVER ()', 'z')} FROM se"),
    "spe_z_rolling": q(price_se, f"SELECT ts, {r(full(f'(se - avg(se) OVER {upto(504)}) / nullif(stddev_samp(se) OVER {upto(504)}, 0)', 'se', upto(504), 504), 'z')} FROM se"),
    "volume_z": q(f"{daily}, {volume.format(src='bars')}", f"SELECT ts, {r('lv', 'lv')}, {r('vol_global_z', 'vol_global_z')}, {r('vol_rolling_z', 'vol_rolling_z')} FROM vz"),
    "volume_sampen": q(f"{daily}, {volume.format(src='bars')}, {sample_entropy('vz', 'vol_global_z', '0.2')}", f"SELECT ts, {r('se', 'vol_sampen')} FROM se"),
    "shannon_fixed": q(
        f"{daily}, {volume.format(src='bars')}, n AS (SELECT *, row_number() OVER {W} AS rn, min(lv) OVER {before(60)} AS lo, max(lv) OVER {before(60)} AS hi FROM vz), "
        "b AS (SELECT t.ts, t.lo, t.hi, least(floor((i.lv - t.lo) / ((t.hi - t.lo) / 10)), 9) AS k, count(*) AS c FROM n t JOIN n i ON i.rn BETWEEN t.rn - 60 AND t.rn - 1 WHERE t.rn > 60 GROUP BY ALL), "
        "h AS (SELECT ts, sum(-(c / 60.0) * ln(c / 60.0)) / ln(10.0) AS h FROM b GROUP BY ts)", f"SELECT n.ts, {r('h', 'shannon')} FROM n LEFT JOIN h USING (ts)"),
    "corr_pairs": q(corr, f"SELECT ts, a, b, {r('r', 'r')} FROM cr WHERE n = 22"),
    "corr_entropy_two": q(two, f"SELECT ts, {r('cse', 'cse')} FROM cse"),
    "breadth_ratio": q(f"{two}, md AS (SELECT *, {full(f'median(cse) OVER {upto(252)}', 'cse', upto(252), 60)} AS m FROM cse)", f"SELECT ts, {r('CASE WHEN m IS NOT NULL AND cse IS NOT NULL THEN least(greatest(CASE WHEN m > 0 THEN cse / m ELSE 1 END, 0.8), 1.5) END', 'ce_ratio')} FROM md"),
    "regime_group_stats": q(labelled, stats),
    "regime_spread": q(labelled, f"SELECT {r('max(m) - min(m)', 'spread')} FROM (SELECT avg(fv20) AS m FROM reg WHERE fv20 IS NOT NULL GROUP BY regime)"),
    "kruskal": q(
        f"{labelled}, rk AS (SELECT regime, rank() OVER (ORDER BY fv20) + (count(*) OVER (PARTITION BY fv20) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY fv20) AS t FROM reg WHERE fv20 IS NOT NULL), "
        "gr AS (SELECT sum(r) AS s, count(*) AS n FROM rk GROUP BY regime), tt AS (SELECT count(*)::DOUBLE AS n, sum(t * t - 1.0) AS ties FROM rk), "
        "h AS (SELECT tt.n, count(*) AS k, (12 / (tt.n * (tt.n + 1)) * sum(s * s / gr.n) - 3 * (tt.n + 1)) / (1 - any_value(ties) / (tt.n * tt.n * tt.n - tt.n)) AS h FROM gr, tt GROUP BY tt.n)",
        f"SELECT n::BIGINT AS n, k, {r('h', 'h')}, {r('exp(-h / 2)', 'p')} FROM h"),
    "hit_rate_grid": q(labelled, hits),
    "lift_contrast": q(f"{labelled}, whole AS (SELECT * FROM reg WHERE fdd5 IS NOT NULL AND fdd10 IS NOT NULL AND fdd20 IS NOT NULL)", contrast),
    "market_lift": q(
        f"{segment}, {wpe('lr')}, fw AS (SELECT *, {forward} FROM wpe), lab AS (SELECT *, ntile(3) OVER (PARTITION BY ticker ORDER BY round(wpe, 9), ts) - 1 AS label FROM fw WHERE wpe IS NOT NULL), "
        "reg AS (SELECT *, CASE label WHEN 0 THEN 'Deterministic' WHEN 1 THEN 'Transitional' ELSE 'Stochastic' END AS regime FROM lab), th AS (SELECT unnest([5.0, 20.0, 60.0])::DOUBLE AS threshold), "
        "ba AS (SELECT ticker, threshold, avg((runup10 > threshold)::INT) AS base FROM fw, th WHERE runup10 IS NOT NULL GROUP BY ALL), "
        "gr AS (SELECT ticker, regime, threshold, count(*) AS n, avg((runup10 > threshold)::INT) AS rate FROM reg, th WHERE runup10 IS NOT NULL GROUP BY ALL)",
        f"SELECT ticker, regime, threshold, n, {r('rate', 'rate')}, {r('base', 'base_rate')}, {r('rate / nullif(base, 0)', 'lift')} FROM gr JOIN ba USING (ticker, threshold)"),
    "lift_table": q(f"{labelled}, hh AS (SELECT regime, (runup10 > 20)::INT::DOUBLE AS hit FROM reg WHERE runup10 IS NOT NULL), ba AS (SELECT avg(hit) AS base FROM hh)", f"SELECT regime, {r('avg(hit)', 'rate')}, {r('any_value(base)', 'base_rate')}, {r('avg(hit) / nullif(any_value(base), 0)', 'lift')} FROM hh, ba GROUP BY regime"),
    "lead_lag": q(f"{DW}, ll AS (SELECT ticker, wpe, {', '.join(f'lead(rv22, {k}) OVER {W} AS y{k}' for k in (0, 5, 10, 20))} FROM wpe)", leads),
    "value_counts": q(labelled, "SELECT regime, count(*) AS n FROM reg GROUP BY regime"),
    "alert_names": q(f"{labelled}, al AS (SELECT CASE regime WHEN 'Deterministic' THEN 'Chaos' WHEN 'Transitional' THEN 'Fragile' ELSE 'Stable' END AS alert FROM reg)", "SELECT alert, count(*) AS n, max((alert = 'Chaos')::INT) AS is_chaos FROM al GROUP BY alert"),
    "ljung_box": q(f"{daily}, {lr}, dv AS (SELECT ticker, ts, lr * lr * 100 - avg(lr * lr * 100) OVER () AS d FROM lr WHERE lr IS NOT NULL)", f"{_box(10)} UNION ALL {_box(20)}"),
    "qlike_mse": q(fc, f"SELECT ticker, forecast, {', '.join(r(c, c) for c in ('qlike', 'mse', 'r', 'r_sigma'))} FROM ({scores})"),
    "cum_qlike": q(fc, f"SELECT ts, {r(f'sum((u60 - ln(u60) - 1) - (u22 - ln(u22) - 1)) OVER {frame("UNBOUNDED PRECEDING", "CURRENT ROW")}', 'cum_adv')} FROM ql WHERE rv IS NOT NULL AND f22 IS NOT NULL AND f60 IS NOT NULL"),
    "forecast_winner": q(fc, f"SELECT arg_min(forecast, qlike) AS winner, {r('(1 - min(qlike) / max(qlike)) * 100', 'improvement_pct')} FROM ({scores})"),
    "var_es": q(f"{daily}, {lr}, ct AS (SELECT quantile_cont(lr, 0.05) AS v FROM lr)", f"SELECT ticker, {r('v', 'var')}, {r('avg(lr) FILTER (WHERE lr < v)', 'es')} FROM lr, ct GROUP BY ticker, v"),
    "market_verdicts": q(
        f"{segment}, {wpe('lr')}, fw AS (SELECT *, {forward} FROM wpe), lab AS (SELECT *, ntile(3) OVER (PARTITION BY ticker ORDER BY round(wpe, 9), ts) - 1 AS label FROM fw WHERE wpe IS NOT NULL), "
        "gm AS (SELECT ticker, label, count(*) AS c, avg(fv20) AS m FROM lab WHERE fv20 IS NOT NULL GROUP BY ALL HAVING count(*) >= 5), "
        "ok AS (SELECT ticker, label, fv20 FROM lab SEMI JOIN gm USING (ticker, label) WHERE fv20 IS NOT NULL), "
        "rk AS (SELECT ticker, label, rank() OVER (PARTITION BY ticker ORDER BY fv20) + (count(*) OVER (PARTITION BY ticker, fv20) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY ticker, fv20) AS t FROM ok), "
        "gr AS (SELECT ticker, sum(r) AS s, count(*) AS n FROM rk GROUP BY ticker, label), tt AS (SELECT ticker, count(*)::DOUBLE AS n, sum(t * t - 1.0) AS ties FROM rk GROUP BY ticker), "
        "h AS (SELECT ticker, tt.n, count(*) AS k, (12 / (tt.n * (tt.n + 1)) * sum(s * s / gr.n) - 3 * (tt.n + 1)) / (1 - any_value(ties) / (tt.n * tt.n * tt.n - tt.n)) AS h FROM gr JOIN tt USING (ticker) GROUP BY ticker, tt.n), "
        "mm AS (SELECT ticker, max(m) FILTER (WHERE label = 0) AS lo, max(m) FILTER (WHERE label = 2) AS hi FROM gm GROUP BY ticker), "
        "al AS (SELECT * FROM (SELECT DISTINCT ticker FROM bars) LEFT JOIN mm USING (ticker) LEFT JOIN h USING (ticker))",
        f"SELECT ticker, n::BIGINT AS n, k, {r('CASE WHEN k > 1 THEN h END', 'h')}, {r('CASE k WHEN 3 THEN exp(-h / 2) END', 'p')}, {r('lo', 'low_wpe')}, {r('hi', 'high_wpe')}, coalesce(lo > hi, false) AS paradox, "
        "CASE WHEN coalesce(k, 0) < 2 THEN 'SKIP' WHEN NOT coalesce(lo > hi, false) THEN 'FAIL' WHEN exp(-h / 2) < 0.05 THEN 'PASS' ELSE 'PARTIAL' END AS verdict FROM al"),
    "gmm_posterior": q(posterior, f"SELECT ts, {', '.join(r(f'p{k}', f'p{k}') for k in range(3))}, top AS label FROM lb"),
    "semantic_shares": q(posterior, f"SELECT ts, {r('p1', 'q0')}, {r('p0 + p2', 'q1')} FROM po"),
    "cluster_semantics": q(f"{moments}, ra AS (SELECT cluster, (row_number() OVER (ORDER BY round(mx + my, 9)) - 1)::INT AS label FROM mo)", "SELECT cluster, label, ['Deterministic', 'Transitional', 'Stochastic'][1 + label] AS name FROM ra"),
    "gmm_ellipse": q(ell, f"SELECT cluster::INT AS cluster, {', '.join(r(c, c) for c in ('cx', 'cy', 'width', 'height', 'angle'))} FROM el"),
    "ellipse_polyline": q(
        f"{ell}, pp AS (SELECT *, i * {2 * math.pi / 99!r} AS t, radians(angle) AS a FROM el, (SELECT unnest(range(100))::INT AS i))",
        f"SELECT cluster::INT AS cluster, i, {r('cx + width / 2 * cos(t) * cos(a) - height / 2 * sin(t) * sin(a)', 'x')}, {r('cy + width / 2 * cos(t) * sin(a) + height / 2 * sin(t) * cos(a)', 'y')} FROM pp"),
    "yeo_johnson": q(f"{daily}, {lr}, yj AS (SELECT ts, {_yj} AS y FROM lr)", f"SELECT ts, {r('y', 'yj')}, {r('(y - avg(y) OVER ()) / stddev_pop(y) OVER ()', 'yj_z')} FROM yj"),
    "hysteresis_labels": q(held, "SELECT ts, raw, held FROM hl", True),
    "stream_hysteresis": q(held, "SELECT ts, held FROM hl", True),
    "stream_hysteresis_reset": q(split, "SELECT ts, held FROM hl", True),
    "hysteresis_golden": q(brands_held, "SELECT ticker, ts, held FROM hl", True),
    "label_flips": q(f"{held}, fl AS (SELECT *, (held <> lag(held) OVER {W})::INT AS f FROM hl)", f"SELECT ticker, count(*) AS n_bars, coalesce(sum(f), 0)::BIGINT AS flips, {r('sum(f) * 252.0 / count(*)', 'flips_per_year')} FROM fl GROUP BY ticker", True),
    "label_diagnostics": q(
        f"{held}, fl AS (SELECT *, (held <> lag(held) OVER {W})::INT AS fh, (raw <> lag(raw) OVER {W})::INT AS fr FROM hl)",
        f"SELECT ticker, count(*) AS n_bars, sum(fr)::BIGINT AS raw_flips, sum(fh)::BIGINT AS held_flips, {r('avg((raw = held)::INT)', 'agreement')}, greatest(0, sum(fr) - sum(fh))::BIGINT AS suppressed, {r('sum(fr) * 252.0 / count(*)', 'raw_per_year')}, {r('sum(fh) * 252.0 / count(*)', 'held_per_year')} FROM fl GROUP BY ticker", True),
    "regime_islands": q(
        f"{held}, ch AS (SELECT *, coalesce((held <> lag(held) OVER {W})::INT, 0) AS c FROM hl), rn AS (SELECT *, sum(c) OVER {frame('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS run FROM ch)",
        "SELECT run::BIGINT AS run, held, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_bars FROM rn GROUP BY run, held", True),
    "garch_exog": q(_exo, f"SELECT ts, {r('h_price', 'h_price')}, {r('h_volume', 'h_volume')}, {r(f'ln(close / lag(close) OVER {W}) * 100', 'pct')} FROM ex2"),
    "garch_variance": q(
        f"{daily}, {lr}, nn AS (SELECT ts, lr * 100 AS p, row_number() OVER (ORDER BY ts) AS n FROM lr WHERE lr IS NOT NULL), "
        f"gv AS (SELECT n, {GARCH['start']!r}::DOUBLE AS s2 FROM nn WHERE n = 1 UNION ALL SELECT nn.n, {GARCH['omega']!r} + {GARCH['alpha']!r} * pow(b.p - {GARCH['mu']!r}, 2) + {GARCH['beta']!r} * gv.s2 FROM gv JOIN nn ON nn.n = gv.n + 1 JOIN nn b ON b.n = gv.n)",
        f"SELECT ts, {r('sqrt(s2)', 'cond_vol')}, {r(f'sqrt(s2) * {math.sqrt(252)!r}', 'cond_vol_annual')} FROM gv JOIN nn USING (n)", True),
    "regime_multiplier": q(decisions, f"SELECT ticker, ts, price_mult, volume_mult, mult, CASE WHEN price_mult >= volume_mult THEN 'Price' ELSE 'Volume' END AS mult_source, s AS sigma_adjusted FROM de"),
    "verdicts": q(decisions, f"SELECT {_code} AS code, {_spec} AS spec, CASE WHEN s >= 1.5 THEN 'danger' WHEN s >= 0.8 THEN 'caution' ELSE 'calm' END AS zone, count(*) AS n FROM de GROUP BY ALL"),
    "divergence_alerts": q(decisions, "SELECT CASE WHEN regime = 'Deterministic' AND flow <> 'Consensus Flow' THEN 'HOLLOW RALLY' WHEN regime = 'Stochastic' AND vol_global_z < 0 THEN 'CAPITULATION VACUUM' WHEN vol_global_z > 0 AND s >= 1.5 THEN 'CLIMAX DISTRIBUTION' ELSE 'NONE' END AS alert, count(*) AS n FROM de GROUP BY ALL"),
    "trajectory_class": q(decisions, f"SELECT CASE WHEN {_v} > 0 AND {_a} > 0 THEN 'accelerating_up' WHEN {_v} > 0 AND {_a} < 0 THEN 'rising_slower' WHEN {_v} < 0 AND {_a} < 0 THEN 'cooling_fast' WHEN {_v} < 0 AND {_a} > 0 THEN 'falling_slower' ELSE 'stationary' END AS trajectory, {_trend} AS trend, count(*) AS n FROM de GROUP BY ALL"),
    "conclusion_keys": q(decisions, f"SELECT CASE WHEN regime = 'Deterministic' THEN 'Deterministic/' || CASE WHEN above THEN 'above' ELSE 'below' END || '/' || CASE WHEN {_v} > 0.005 THEN 'rising' ELSE 'other' END ELSE regime || '/' || {_trend} END AS conclusion_key, count(*) AS n FROM de GROUP BY ALL"),
    "wpe_order4": q(
        f"{daily}, {lr}, x4 AS (SELECT *, lag(lr, 3) OVER {W} AS a, lag(lr, 2) OVER {W} AS b, lag(lr, 1) OVER {W} AS c, lr AS d, row_number() OVER {W} AS rn FROM lr), "
        "p4 AS (SELECT rn, (a <= b)::INT + 2 * (a <= c)::INT + 4 * (a <= d)::INT + 8 * (b <= c)::INT + 16 * (b <= d)::INT + 32 * (c <= d)::INT AS k, list_var_pop([a, b, c, d]) AS wt FROM x4 WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL), "
        "w4 AS (SELECT t.rn, k, sum(wt) AS w FROM x4 t JOIN p4 ON p4.rn BETWEEN t.rn - 57 AND t.rn - 1 WHERE t.rn > 60 GROUP BY ALL), s4 AS (SELECT rn, w / sum(w) OVER (PARTITION BY rn) AS p FROM w4 QUALIFY sum(w) OVER (PARTITION BY rn) > 0), "
        f"e4 AS (SELECT rn, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS sp, sum(-((p + {1 / 24!r}) / 2) * ln((p + {1 / 24!r}) / 2)) + (24 - count(*)) * {-(1 / 48) * math.log(1 / 48)!r} AS sm FROM s4 GROUP BY rn)",
        f"SELECT ts, {r(f'sp / {math.log(24)!r}', 'wpe')}, {r(f'(sm - sp / 2 - {math.log(24) / 2!r}) / {_best(24) - math.log(24) / 2!r} * sp / {math.log(24)!r}', 'complexity')} FROM x4 LEFT JOIN e4 USING (rn)"),
    "shannon_auto": q(
        # bins as numpy's "auto": the narrower of Sturges' width and Freedman-Diaconis', the latter at least half of the square root's
        f"{daily}, {volume.format(src='bars')}, n AS (SELECT ts, vol_global_z AS x, row_number() OVER {W} AS rn, list(vol_global_z) OVER {before(60)} AS seg FROM vz), "
        "s1 AS (SELECT rn, ts, seg, list_min(seg) AS lo, list_max(seg) AS hi, list_aggregate(seg, 'quantile_cont', 0.75) - list_aggregate(seg, 'quantile_cont', 0.25) AS iqr FROM n WHERE rn > 60), "
        "s2 AS (SELECT *, least(greatest(2 * iqr / pow(60, 1 / 3.0), (hi - lo) / sqrt(60.0) / 2), (hi - lo) / (log2(60.0) + 1)) AS width FROM s1), "
        "s3 AS (SELECT rn, lo, hi, ceil((hi - lo) / width)::INT AS bins, unnest(seg) AS v FROM s2 WHERE hi > lo), "
        "s4 AS (SELECT rn, bins, least(floor((v - lo) / (hi - lo) * bins)::INT, bins - 1) AS b, count(*) AS c FROM s3 GROUP BY ALL), "
        "s5 AS (SELECT rn, CASE WHEN bins < 2 THEN 0 ELSE least(1, greatest(0, sum(-(c / 60.0) * ln(c / 60.0)) / ln(bins))) END AS h FROM s4 GROUP BY rn, bins)",
        f"SELECT ts, {r('CASE WHEN n.rn > 60 THEN coalesce(h, 0) END', 'shannon')} FROM n LEFT JOIN s5 USING (rn)"),
    "tool_results_json": q(
        DW, "SELECT 'market_data' AS tool, '{\"status\":\"success\",\"n_bars\":' || count(*) || ',\"first\":\"' || min(ts) || '\",\"last\":\"' || max(ts) || '\"}' AS result FROM bars UNION ALL "
        "SELECT 'price_metrics', '{\"status\":\"success\",\"date\":\"' || ts || '\",\"wpe\":' || round(wpe, 4) || ',\"mfi\":' || round(wpe * (1 - complexity), 4) || '}' FROM (SELECT * FROM wpe WHERE wpe IS NOT NULL ORDER BY ts DESC LIMIT 1)"),
    "calibration_rank": q(
        f"""{posterior}, gd AS (SELECT * FROM (SELECT unnest([0.3, 0.4, 0.5, 0.6])::DOUBLE AS hard), (SELECT unnest([0.15, 0.2, 0.25, 0.3, 0.35])::DOUBLE AS soft), (SELECT unnest([3, 5, 8, 13, 21])::INT AS persist) WHERE hard >= soft),
cal AS (SELECT hard, soft, persist, n, top AS held, -1 AS pending, 0 AS cnt FROM lb, gd WHERE n = 1
  UNION ALL
  SELECT hard, soft, persist, n, CASE WHEN flip THEN top ELSE old END, CASE WHEN NOT flip AND margin >= soft THEN top ELSE -1 END, CASE WHEN NOT flip AND margin >= soft THEN c ELSE 0 END FROM (
    SELECT *, top = old OR margin >= hard OR (margin >= soft AND c >= persist) AS flip FROM (
      SELECT cal.hard, cal.soft, cal.persist, lb.n, lb.top, cal.held AS old, CASE WHEN cal.pending = lb.top THEN cal.cnt + 1 ELSE 1 END AS c, lb.pt - CASE cal.held WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS margin
      FROM cal JOIN lb ON lb.n = cal.n + 1))),
ch AS (SELECT *, (held <> lag(held) OVER x)::INT AS fh, (top <> lag(top) OVER x)::INT AS fr, (top = held)::INT AS same FROM cal JOIN (SELECT ticker, n, top FROM lb) USING (n) WINDOW x AS (PARTITION BY hard, soft, persist ORDER BY n)),
fi AS (SELECT ticker, hard, soft, persist, coalesce(sum(fr), 0) * 252.0 / count(*) AS raw_per_year, coalesce(sum(fh), 0) * 252.0 / count(*) AS held_per_year, avg(same) AS agreement FROM ch GROUP BY ALL),
fo AS (SELECT *, held_per_year BETWEEN 4 AND 10 AS in_band, abs(held_per_year - 7) AS distance, round(hard - soft, 6) AS width FROM fi)""",
        f"SELECT ticker, hard, soft, persist, {r('raw_per_year', 'raw_per_year')}, {r('held_per_year', 'held_per_year')}, {r('agreement', 'agreement')}, in_band, {r('distance', 'distance')}, width, row_number() OVER (PARTITION BY ticker ORDER BY in_band DESC, round(distance, 6), width, persist, hard)::INT AS place FROM fo", True),
    "lookahead_gap": q(
        f"{daily.replace('bars AS', 'bars0 AS')}, bars AS (SELECT * FROM bars0), {volume.format(src='bars')}, "
        f"lv2 AS (SELECT *, ln(1 + greatest(volume * CASE WHEN ts > '{PIVOT}' THEN 3 ELSE 1 END, 0)) AS lv FROM bars), "
        f"vz2 AS (SELECT *, (lv - avg(lv) OVER (PARTITION BY ticker)) / stddev_samp(lv) OVER (PARTITION BY ticker) AS g, (lv - avg(lv) OVER {upto(252)}) / nullif(stddev_samp(lv) OVER {upto(252)}, 0) AS z FROM lv2), "
        f"co AS (SELECT ts FROM vz WHERE ts <= '{PIVOT}' AND vol_rolling_z IS NOT NULL INTERSECT SELECT ts FROM vz2 WHERE z IS NOT NULL)",
        f"SELECT count(*) AS n_common, {r('median(abs(vol_rolling_z - z) / nullif(abs(vol_rolling_z), 0))', 'rolling_gap')}, {r('median(abs(vol_global_z - g) / nullif(abs(vol_global_z), 0))', 'global_gap')} FROM co JOIN vz USING (ts) JOIN vz2 USING (ts)"),
    "breadth_labels": q(two, f"SELECT ts, {r('cse', 'cse')}, CASE WHEN round(cse, 6) < 40 THEN 'COHESIVE' WHEN round(cse, 6) > 70 THEN 'DISLOCATED' ELSE 'FRAGMENTING' END AS label FROM cse"),
}
SQL["calibration_sql"] = SQL["calibration_rank"]
