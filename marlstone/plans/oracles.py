"""The registered panel queries as SQL for a second engine: common table expressions and one select for each query."""

from __future__ import annotations

from itertools import combinations

from ..functions.normal import lit
from ..operators.features import ffd_weights
from ..operators.stats import expected_best_sql, psr_sql
from ..operators.trials import SEEDS

W = "partition by ticker order by date"


def damped(x: str) -> str:
    return f"round(100 * pow({x} / 2000.0, 0.02), 6)"


TRADES = """trades as (select p_brand as ticker, cast(l_shipdate as date) as date, p_retailprice, lineitem.*
  from lineitem join part on l_partkey = p_partkey)"""
BARS = f"""bars as (select ticker, date,
  {damped("cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / sum(l_quantity)")} as close,
  {damped("max(l_extendedprice / l_quantity)")} as high, {damped("min(l_extendedprice / l_quantity)")} as low,
  sum(l_quantity) as volume,
  {damped("arg_min(l_extendedprice / l_quantity, row(l_orderkey, l_linenumber, l_partkey, l_suppkey))")} as open
  from trades group by ticker, date)"""
X = f"""x as (select *, row_number() over ({W}) as idx, ln(close / lag(close) over ({W})) as lr,
  close - lag(close) over ({W}) as dp, close * volume as dv, ln(close) as lc from bars)"""
BASE = f"with {TRADES}, {BARS}, {X}"


def roll(fn: str, x: str, n: int) -> str:
    frame = f"over ({W} rows between {n - 1} preceding and current row)"
    return f"case when count({x}) {frame} = {n} then {fn}({x}) {frame} end"


def cols(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) as {n}" for n in names)


def simple(*pairs: tuple[str, str], ctes: str = "", src: str = "x") -> str:
    made = ", ".join(f"{sql} as {name}" for name, sql in pairs)
    return f"{BASE}{ctes}, y as (select ticker, date, {made} from {src}) select ticker, date, {cols(*[p[0] for p in pairs])} from y"


def ffd(x: str) -> str:
    return " + ".join(f"({w!r}::double) * " + (f"lag({x}, {k}) over ({W})" if k else x) for k, w in enumerate(ffd_weights()))


_B = 1 - 2 / 21
SIGMA = f"""e as (select *, (idx - 1)::double as i,
    sum(lr * pow({_B!r}::double, -(idx - 1)::double)) over ({W}) as a1, sum(lr * lr * pow({_B!r}::double, -(idx - 1)::double)) over ({W}) as a2,
    (1 - pow({_B!r}::double, (idx - 1)::double)) / {1 - _B!r}::double as w1, (1 - pow({_B!r}::double, 2 * (idx - 1)::double)) / {1 - _B**2!r}::double as w2 from x),
 sig as (select *, case when i >= 2 then sqrt(greatest(0.0::double,
    (a2 * pow({_B!r}::double, i) / w1 - pow(a1 * pow({_B!r}::double, i) / w1, 2)) * w1 * w1 / nullif(w1 * w1 - w2, 0))) end as sigma from e)"""
LABELS = f"""{SIGMA},
 hits as (select a.ticker, a.idx, min(b.idx) as hit from sig a join sig b on a.ticker = b.ticker and b.idx between a.idx + 1 and a.idx + 10
   where b.high >= a.close * (1 + 2 * a.sigma) or b.low <= a.close * (1 - 2 * a.sigma) group by all),
 lens as (select ticker, max(idx) as n from sig group by ticker),
 res as (select sig.*, hits.hit, coalesce(hits.hit, least(sig.idx + 10, n)) as r from sig join lens using (ticker) left join hits using (ticker, idx)
   where sigma > 0 and sig.idx < n),
 lab as (select s.ticker, s.date, s.idx, s.close, s.high, s.low, s.volume, s.lr, s.dp, s.dv, s.lc, s.sigma, r.r as res_idx, b.date as t1, b.close / s.close - 1 as fwd_ret,
   case when r.r is null then null when r.hit is null then 'vert' when b.high >= s.close * (1 + 2 * s.sigma) and b.low <= s.close * (1 - 2 * s.sigma) then 'both->sl'
     when b.high >= s.close * (1 + 2 * s.sigma) then 'pt' else 'sl' end as barrier
   from sig s left join res r using (ticker, idx) left join sig b on b.ticker = s.ticker and b.idx = r.r),
 labels_ as (select *, case when barrier is not null then (barrier = 'pt')::int end as label from lab)"""
CONC = f""", steps as (select ticker, idx, sum(s) as s from (select ticker, idx, 1 as s from labels_ where res_idx is not null union all
   select ticker, res_idx + 1, -1 from labels_ where res_idx is not null) group by all),
 conc as (select labels_.*, coalesce(sum(coalesce(s, 0)) over (partition by ticker order by idx), 0)::bigint as conc from labels_ left join steps using (ticker, idx))"""
UNIQ = """, uniq as materialized (select a.ticker, a.date, a.idx, avg(1.0::double / nullif(b.conc, 0)) as uniq from conc a join conc b
   on a.ticker = b.ticker and b.idx between a.idx and a.res_idx group by all)"""


def pct(x: str) -> str:
    return f"""case when {x} is not null then (rank() over (partition by date, {x} is null order by {x}) + (count(*) over (partition by date, {x}) - 1) / 2.0::double)
      / count({x}) over (partition by date) end"""


def avg_rank(x: str, key: str) -> str:
    return f"(rank() over (partition by {key} order by {x}) + (count(*) over (partition by {key}, {x}) - 1) / 2.0::double)"


SCORED = f"""{LABELS}, m as (select *, close / lag(close, 21) over ({W}) - 1 as mom from labels_),
 ranked as (select *, {pct("mom")} as score from m), scored as (select * from ranked where score is not null and label is not null)"""
FUND = """, q as (select ticker, (date_trunc('quarter', date) + interval 3 month - interval 1 day)::date as end_date,
    cast(sum(cast(p_retailprice as decimal(18,2))) as double) / count(*) as book_value,
    cast(sum(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2))) as double) / sum(l_quantity) as eps,
    1 - cast(sum(cast(l_discount as decimal(4,2))) as double) / count(*) - cast(sum(cast(l_tax as decimal(4,2))) as double) / count(*) as profit_margin,
    cast(sum(cast(l_tax as decimal(4,2))) as double) / count(*) as div_yield_raw from trades group by 1, 2),
 fund as (select ticker, end_date, book_value, case when row_number() over (partition by ticker order by end_date) % 5 <> 0 then eps end as trailing_eps,
    profit_margin, div_yield_raw, (end_date + interval 90 day)::date as available from q)"""
ASOF = FUND + """, asof_ as (select x.*, f.end_date, f.book_value, f.trailing_eps, f.profit_margin, f.div_yield_raw from x asof left join fund f
   on x.ticker = f.ticker and x.date >= f.available),
 factors as (select *, trailing_eps / close as earnings_yield, book_value / close as book_to_price, div_yield_raw as div_yield from asof_)"""
FACTOR = """, ev as (select ticker, min(date) as ex_date, arg_min(v, date) as value from (select ticker, date,
    cast(sum(cast(l_discount as decimal(4,2))) as double) / count(*) as v from trades group by all) group by ticker, year(date)),
 fac as (select x.ticker, x.date, x.close, coalesce(list_reduce(list(greatest(0.0::double, 1 - value / 1.0::double) order by ex_date desc) filter (where value is not null),
   lambda a, b: a * b), 1.0::double) as factor
   from x left join ev on x.ticker = ev.ticker and x.date < ev.ex_date group by all)"""
RAW = """, raw as (select bars.*, close * (1 - v / 10) as adj from bars join (select ticker, date,
    cast(sum(cast(l_discount as decimal(4,2))) as double) / count(*) as v from trades group by all) using (ticker, date))"""
DATES = ", dates as (select date, row_number() over (order by date) - 1 as pos from (select distinct date from bars))"


def booked(src: str, stride: int, low: float, high: float, least: int) -> str:
    """CTEs held (k, date, ticker, w, ret), trades as moved (k, ticker, dw)."""
    return f""", grid as (select date from (select date, row_number() over (order by date) - 1 as pos from (select distinct date from {src[0]})) where pos % {stride} = 0),
 on_ as (select date, ticker, score, fwd_ret as ret from {src[0]} where date in (select date from grid) and {src[1]}),
 qs as (select date, quantile_cont(score, {high!r}) as hi, quantile_cont(score, {low!r}) as lo, count(*) as n from on_ group by date having count(*) >= {least}),
 legs as (select on_.*, hi, lo, count_if(score >= hi) over (partition by date) as nl, count_if(score <= lo) over (partition by date) as ns from on_ join qs using (date)),
 held as (select dense_rank() over (order by date) as k, date, ticker, case when score <= lo then -0.5::double / ns else 0.5::double / nl end as w, ret
   from legs where nl > 0 and ns > 0 and (score <= lo or score >= hi)),
 moved as (select k, ticker, sum(w) as dw from (select k, ticker, w from held union all select k + 1, ticker, -w from held) group by all
   having k <= (select max(k) from held))"""


def costs(capital: float, half: float, sigma: float) -> str:
    return f""", adv as (select ticker, quantile_cont(dv, 0.5) as adv from x group by ticker),
 paid as (select k, sum(abs(dw) * ({half!r}::double + {sigma!r}::double * sqrt(case when adv > 0 then abs(dw) * {capital!r}::double / adv else 0.01 end) * 1e4) / 1e4) as cost,
   sum(abs(dw)) as turnover from moved left join adv using (ticker) where dw <> 0 group by k),
 earned as (select k, date, sum(coalesce(w * ret, 0)) as gross from held group by all)
 select date, round(gross, 6) as gross, round(coalesce(cost, 0), 6) as cost, round(gross - coalesce(cost, 0), 6) as net, round(coalesce(turnover, 0), 6) as turnover
   from earned left join paid using (k)"""


MOM_FWD = f"""{BASE}, m as (select *, close / lag(close, 21) over ({W}) - 1 as mom, lead(close, 63) over ({W}) / close - 1 as fwd_ret from x),
 p as (select *, {pct("mom")} as score from m)"""
TERCILE = MOM_FWD + booked(("p", "score is not null and fwd_ret is not null"), 63, 1 / 3, 2 / 3, 12)
SENSOR = f"""{BASE}, {SCORED}, med as (select date, quantile_cont(score, 0.5) as m, count(*) as n from scored group by date having count(*) >= 4),
 sensor as (select date, avg(case when score > m then fwd_ret end) - avg(case when score < m then fwd_ret end) as ls from scored join med using (date) group by date),
 ls as (select * from sensor where ls is not null)"""
SUMMARY = SENSOR + """, summ as (select count(ls) as n, count(ls)::double as nd, avg(ls) as mean, avg(ls) / nullif(stddev_samp(ls), 0) as sharpe, skewness(ls) as skew, kurtosis(ls) + 3 as kurt from ls)"""
ROLLED = ", rolled as (select *, "


def mask(sql: str) -> str:
    return f"case when {sql} is not null and not isnan({sql}) then {sql} end"


Z = f"""z1 as (select *, (lr - ({roll("avg", "lr", 63)})) / nullif(({roll("stddev_samp", "lr", 63)}), 0) as z from x),
 z2 as (select *, sum(coalesce(z, 0)) over ({W} rows unbounded preceding) as cz from z1)"""
CUSUM = "greatest(" + ", ".join(f"abs(cz - coalesce(lag(cz, {j}) over ({W}), 0)) / {float(j) ** 0.5!r}::double" for j in range(1, 64)) + ")"
EXPLOSIVE = f"""{BASE}, y1 as (select *, lc - first_value(lc) over ({W} rows unbounded preceding) as y from x),
 y2 as (select *, lag(y) over ({W}) as yl, y - lag(y) over ({W}) as dy from y1),
 w as (select unnest(range(20, 81)) as n),
 pre as (select ticker, date, idx, sum(coalesce(yl, 0)) over o as s1, sum(coalesce(dy, 0)) over o as s2, sum(coalesce(yl * yl, 0)) over o as s3,
   sum(coalesce(yl * dy, 0)) over o as s4, sum(coalesce(dy * dy, 0)) over o as s5 from y2 window o as ({W} rows unbounded preceding)),
 d as (select a.ticker, a.date, n, a.s1 - b.s1 as sx, a.s2 - b.s2 as sy, a.s3 - b.s3 as sxx, a.s4 - b.s4 as sxy, a.s5 - b.s5 as syy
   from pre a cross join w join pre b on a.ticker = b.ticker and b.idx = a.idx - n),
 v as (select ticker, date, n, sxx - sx * sx / n as vx, syy - sy * sy / n as vy, sxy - sx * sy / n as cxy from d),
 r as (select ticker, date, n, cxy / sqrt(vx * vy) as r from v where vx > 0 and vy > 0),
 best as (select ticker, date, max(r * sqrt((n - 2) / (1 - r * r))) as explosivity from r where abs(r) < 1 group by all)
 select ticker, date, round(explosivity, 6) as explosivity from x left join best using (ticker, date)"""

_PAIRS = list(combinations(range(6), 2))
ROLES = f"""{BASE}, {LABELS}, s as (select ticker, date, t1 from labels_ where t1 is not null),
 g as (select date, pos, ntile(6) over (order by pos) - 1 as b from (select date, row_number() over (order by date) - 1 as pos from (select distinct date from s))),
 spans as (select b, min(date) as b0, max(date) as b1, max(pos) as p1 from g group by b),
 lim as (select spans.*, (select date from g where pos = least(p1 + 55, (select max(pos) from g))) as until from spans),
 combo as (select * from (values {", ".join(f"({i}, {a}, {c})" for i, (a, c) in enumerate(_PAIRS))}) t(split_id, ta, tb)),
 r as (select split_id, s.ticker, s.date, case when g.b in (ta, tb) then 'test' when not (
     (t1 >= l1.b0 and s.date <= l1.b1) or (s.date > l1.b1 and s.date <= l1.until) or (t1 >= l2.b0 and s.date <= l2.b1) or (s.date > l2.b1 and s.date <= l2.until)) then 'train' end as role
   from s join g using (date) cross join combo join lim l1 on l1.b = ta join lim l2 on l2.b = tb)
 select split_id::bigint as split_id, ticker, role, count(*) as n, sum(datediff('day', date '1970-01-01', date))::bigint as day_sum from r where role is not null group by all"""

CPCV = f"""{BASE}, {SCORED}, g as (select date, ntile(6) over (order by date) - 1 as b from (select distinct date from scored)),
 combo as (select * from (values {", ".join(f"({i}, {a}, {c})" for i, (a, c) in enumerate(_PAIRS))}) t(split_id, ta, tb)),
 te as (select split_id::bigint as split_id, scored.ticker, scored.date, score, label, fwd_ret from scored join g using (date) join combo on b = ta or b = tb),
 rk as (select split_id, label, {avg_rank("score", "split_id")} as r from te),
 au as (select split_id, count(*) as n, sum(label)::double as n1, count(*) - sum(label)::double as n0, sum(case when label = 1 then r end) as s from rk group by split_id),
 med as (select split_id, date, quantile_cont(score, 0.5) as m from te group by all having count(*) >= 4),
 sens as (select split_id, date, avg(case when score > m then fwd_ret end) - avg(case when score < m then fwd_ret end) as ls from te join med using (split_id, date) group by all),
 sh as (select split_id, avg(ls) / nullif(stddev_samp(ls), 0) as sharpe from sens where ls is not null group by split_id),
 grid as (select split_id, date from (select split_id, date, row_number() over (partition by split_id order by date) - 1 as pos from (select distinct split_id, date from te)) where pos % 10 = 0),
 on_ as (select te.* from te join grid using (split_id, date)),
 qs as (select split_id, date, quantile_cont(score, 0.5) as m from on_ group by all having count(*) >= 4),
 legs as (select on_.*, m, count_if(score >= m) over (partition by split_id, date) as nl, count_if(score <= m) over (partition by split_id, date) as ns from on_ join qs using (split_id, date)),
 held as (select split_id, dense_rank() over (partition by split_id order by date) as k, ticker, case when score <= m then -0.5::double / ns else 0.5::double / nl end as w, fwd_ret as ret from legs where nl > 0 and ns > 0),
 tops as (select split_id, max(k) as top from held group by split_id),
 moved as (select split_id, k, ticker, sum(w) as dw from (select split_id, k, ticker, w from held union all select split_id, k + 1, ticker, -w from held) group by all),
 adv as (select ticker, quantile_cont(dv, 0.5) as adv from x group by ticker),
 paid as (select split_id, k, sum(abs(dw) * (10.0::double + 0.025::double * sqrt(case when adv > 0 then abs(dw) * 2e7::double / adv else 0.01 end) * 1e4) / 1e4) as cost
   from moved join tops using (split_id) left join adv using (ticker) where dw <> 0 and k <= top group by all),
 earned as (select split_id, k, sum(coalesce(w * ret, 0)) as gross from held group by all),
 net as (select split_id, avg(gross) / nullif(stddev_samp(gross), 0) as sharpe_gross, avg(gross - coalesce(cost, 0)) / nullif(stddev_samp(gross - coalesce(cost, 0)), 0) as sharpe_net, count(*) as rebalances
   from earned left join paid using (split_id, k) group by split_id),
 per_split as (select au.split_id, (s - n1 * (n1 + 1) / 2) / nullif(n1 * n0, 0) as auc, n, sharpe, sharpe_gross, sharpe_net, rebalances from au left join sh using (split_id) left join net using (split_id))"""
_FULL = {
    "mom_21": f"close / lag(close, 21) over ({W}) - 1",
    "vol_21": roll("stddev_samp", "lr", 21),
    "amihud": f"ln(nullif({roll('avg', 'ill', 21)}, 0))",
    "vol_regime": f"({roll('stddev_samp', 'lr', 10)}) / nullif(({roll('stddev_samp', 'lr', 63)}), 0)",
}
_NAMES = ("mom_21", "vol_21", "amihud", "roll_spread", "cusum_vol", "explosivity", "vol_regime", "earnings_yield")

_ROLL_CTE = f""", v as (select *, dp as d0, lag(dp) over ({W}) as d1 from x)"""
_FRAME21 = f"over ({W} rows between 20 preceding and current row)"
_PAIRS21 = f"count(case when d0 is not null and d1 is not null then 1 end) {_FRAME21}"
_ROLL = f"case when {_PAIRS21} = 21 then 2 * sqrt(greatest(0.0::double, -covar_samp(d0, d1) {_FRAME21})) end"

ORACLES: dict[str, str] = {
    "panel_bars": f"with {TRADES}, {BARS} select ticker, date, open, high, low, close, volume from bars",
    "tr_adjust": f"""{BASE}{RAW} select ticker, date, round(open * (adj / close), 9) as open, round(high * (adj / close), 9) as high,
        round(low * (adj / close), 9) as low, round(adj, 9) as close, volume from raw""",
    "panel_filters": f"""{BASE} select ticker, date, close, volume from bars where ticker <> 'Brand#11' and date between date '1993-01-01' and date '1997-12-31'
        and ticker in (select ticker from bars group by ticker having count(*) >= 300)""",
    "panel_coverage": f"{BASE} select count(*) as n_rows, count(distinct ticker) as n_tickers, min(date) as first_date, max(date) as last_date from bars",
    "panel_dedup": f"""with {TRADES} select ticker, date, l_orderkey, l_linenumber, l_extendedprice from trades
        qualify row_number() over (partition by ticker, date order by l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1""",
    "missing_tickers": f"""{BASE}, listed as (select p_brand as ticker from part union select p_type from part)
        select ticker from listed where ticker not in (select ticker from bars)""",
    "universe_select": """with s as (select 'P' || p_partkey || case when p_partkey % 7 = 0 then 'F' else '' end as ticker, p_retailprice as close, p_size * 100.0::double as volume,
        case when p_partkey % 11 <> 0 then round(p_retailprice * p_partkey, 2) end as market_cap from part)
        select ticker, close * volume as adv, market_cap from s where close <> 0 and volume <> 0 and not ends_with(ticker, 'F') and close * volume >= 1e6
        order by coalesce(market_cap, 0) desc, ticker limit 120""",
    "adjustment_factor": f"{BASE}{FACTOR} select ticker, date, factor from fac",  # the same products in the same order: exact
    "factor_check": f"""{BASE}{FACTOR}, st as (select ticker, factor - lag(factor) over ({W}) as s from fac) select ticker, bool_and(coalesce(s >= -1e-9, true)) as rises from st group by ticker""",
    "reference_difference": f"""{BASE}{FACTOR}{RAW} select fac.ticker, fac.date, (fac.close * factor / nullif(adj, 0) - 1) * 100 as pct_diff
        from fac join raw on fac.ticker = raw.ticker and fac.date = raw.date""",
    "momentum": simple(*[(f"mom_{n}", f"close / lag(close, {n}) over ({W}) - 1") for n in (5, 10, 21)]),
    "rolling_vol": simple(*[(f"vol_{n}", roll("stddev_samp", "lr", n)) for n in (10, 21)]),
    "dist_sma": simple(("dist_sma21", f"close / ({roll('avg', 'close', 21)}) - 1")),
    "ewm_vol": f"{BASE}, {SIGMA} select ticker, date, round(sigma, 6) as sigma from sig",
    "rsi": simple(
        ("rsi_14", f"""case when dp is not null then 100 - 100 / (1 + sum(greatest(dp, 0.0::double) * pow({13 / 14!r}::double, -idx::double)) over ({W})
            / nullif(sum(-least(dp, 0.0::double) * pow({13 / 14!r}::double, -idx::double)) over ({W}), 0)) end"""), src="(select * from x)",
    ),
    "fracdiff_close": simple(("fd_close", ffd("lc"))),
    "fracdiff_vol": f"""{BASE}, v as (select ticker, date, {roll("stddev_samp", "lr", 21)} as v from x),
        f as (select ticker, date, last_value(v ignore nulls) over ({W}) as v from v), y as (select ticker, date, {ffd("v")} as fd_vol21 from f)
        select ticker, date, round(fd_vol21, 6) as fd_vol21 from y""",
    "amihud": f"""{BASE}, v as (select *, abs(lr) / nullif(dv, 0) as ill from x), y as (select ticker, date, ln(nullif({roll("avg", "ill", 21)}, 0)) as amihud from v)
        select ticker, date, round(amihud, 6) as amihud from y""",
    "roll_spread": f"{BASE}{_ROLL_CTE}, y as (select ticker, date, {_ROLL} as roll_spread from v) select ticker, date, round(roll_spread, 6) as roll_spread from y",
    "dollar_vol_z": f"""{BASE}, v as (select *, ln(dv) as ldv from x),
        y as (select ticker, date, (ldv - ({roll("avg", "ldv", 63)})) / nullif(({roll("stddev_samp", "ldv", 63)}), 0) as dollar_vol_z from v)
        select ticker, date, round(dollar_vol_z, 6) as dollar_vol_z from y""",
    "turnover_accel": simple(("turnover_accel", f"({roll('avg', 'volume', 5)}) / nullif(({roll('avg', 'volume', 21)}), 0) - 1")),
    "cusum_vol": f"""{BASE}, {Z}, y as (select ticker, date, case when count(z) over ({W} rows between 62 preceding and current row) = 63 then {CUSUM} end as cusum_vol from z2)
        select ticker, date, round(cusum_vol, 6) as cusum_vol from y""",
    "explosivity": EXPLOSIVE,
    "vol_regime": simple(("vol_regime", _FULL["vol_regime"])),
    "forward_return": simple(("fwd", f"lead(close, 63) over ({W}) / close - 1")),
    "cs_pct_rank": f"""{BASE}, m as (select *, close / lag(close, 5) over ({W}) - 1 as m5, close / lag(close, 21) over ({W}) - 1 as m21 from x)
        select ticker, date, round({pct("m5")}, 6) as mom_5_rank, round({pct("m21")}, 6) as mom_21_rank from m""",
    "fundamentals_long": f"""{BASE}{FUND} select ticker, end_date, {cols("book_value", "trailing_eps", "profit_margin", "div_yield_raw")}, available from fund""",
    "asof_fundamentals": f"""{BASE}{ASOF} select ticker, date, end_date, {cols("book_value", "trailing_eps", "profit_margin", "div_yield_raw")} from asof_""",
    "fund_factors": f"""{BASE}{ASOF} select ticker, date, {cols("earnings_yield", "book_to_price", "profit_margin", "div_yield")} from factors""",
    "triple_barrier": f"{BASE}, {LABELS} select ticker, date, round(sigma, 6) as sigma, label::double as label, barrier, round(fwd_ret, 6) as fwd_ret, t1 from labels_",
    "concurrency": f"{BASE}, {LABELS}{CONC} select ticker, date, conc from conc",
    "avg_uniqueness": f"""{BASE}, {LABELS}{CONC}{UNIQ} select conc.ticker, conc.date, round(uniq, 6) as uniq from conc left join uniq using (ticker, idx)""",
    "return_attr_weights": f"""{BASE}, {LABELS}{CONC}, a as (select a.ticker, a.idx, abs(coalesce(sum(b.lr / nullif(b.conc, 0)), 0)) as attr from conc a join conc b
        on a.ticker = b.ticker and b.idx between a.idx and a.res_idx group by all) select conc.ticker, date, round(attr, 6) as attr from conc left join a using (ticker, idx)""",
    "time_decay": f"""{BASE}, {LABELS}{CONC}{UNIQ}, t as (select *, sum(uniq) over (partition by ticker) as total, sum(uniq) over ({W}) as run from uniq),
        h as (select *, uniq * greatest(0.0::double, 1 - 0.5 / total * total + 0.5 / total * run) as half from t),
        h2 as (select *, sum(half) over (partition by ticker) as t2, sum(half) over ({W}) as r2 from h)
        select ticker, date, round(half, 6) as half, round(uniq * greatest(0.0::double, 1 - 2.0 / total * total + 2.0 / total * run), 6) as cut from h2""",
    "panel_weights": f"""{BASE}, {LABELS}{CONC}, p as (select *, sum(1.0::double / nullif(conc, 0)) over (partition by ticker order by idx) as upto from conc),
        w as materialized (select a.ticker, a.date, case when a.res_idx is null then 0 else (b.upto - a.upto + 1.0::double / nullif(a.conc, 0)) / (a.res_idx - a.idx + 1) end as w
          from p a left join p b on a.ticker = b.ticker and b.idx = a.res_idx)
        select ticker, date, round(w / (select avg(w) from w where w > 0), 6) as w from w""",
    "indicator_matrix": f"""{BASE}, {LABELS} select b.ticker, b.idx as bar_idx, count(*) as labels, sum(a.idx)::bigint as label_sum from labels_ a join labels_ b
        on a.ticker = b.ticker and b.idx between a.idx and a.res_idx group by all""",
    "cpcv_blocks": f"{BASE}{DATES} select date, pos, ntile(6) over (order by pos) - 1 as block from dates",
    "cpcv_roles": ROLES,
    "purged_split": f"""{BASE}{DATES}, c as (select floor(count(*) * 0.7)::int as cut from dates),
        r as (select ticker, date, case when pos >= cut then 'test' when pos < greatest(0, cut - 55) then 'train' end as role from bars join dates using (date) cross join c)
        select ticker, role, count(*) as n, min(date) as first_date, max(date) as last_date from r where role is not null group by all""",
    "meta_split": f"""{BASE}, {LABELS}, s as (select ticker, date, t1, datediff('day', date '1970-01-01', date) as day, datediff('day', date '1970-01-01', t1) as day1 from labels_ where t1 is not null),
        c as (select quantile_cont(day, 0.5) as cut from s), r as (select *, case when day > cut then 'meta' when day1 <= cut then 'primary' end as role from s cross join c)
        select ticker, role, count(*) as n, min(date) as first_date, max(date) as last_date from r where role is not null group by all""",
    "effective_n": f"{BASE} select greatest(count(distinct date) // 10, 1)::bigint as n_eff from bars",
    "median_adv": f"{BASE} select ticker, round(quantile_cont(dv, 0.5), 4) as adv from x group by ticker",
    "ls_sensor": f"{SENSOR} select date, round(ls, 6) as ls from ls",
    "sized_ls": f"""{BASE}, {SCORED}, s as (select date, count(*) as n, sum(abs(score - 0.5)) as g, sum(coalesce((score - 0.5) * fwd_ret, 0)) as t from scored group by date)
        select date, round(t / g, 6) as ls from s where n >= 4 and g >= 1e-9""",
    "tercile_book": f"{TERCILE} select k, date, ticker, round(w, 6) as w, round(ret, 6) as ret from held",
    "turnover": f"{TERCILE} select k, round(sum(abs(dw)), 6) as turnover from moved group by k",
    "tercile_costed": TERCILE + costs(2e6, 5.0, 0.025),
    "costed_backtest": f"{BASE}, {SCORED}" + booked(("scored", "score is not null"), 10, 0.5, 0.5, 4) + costs(2e7, 10.0, 0.025),
    "fundamental_tilt": f"""{BASE}{ASOF}, fr as (select *, {pct("earnings_yield")} as r1, {pct("book_to_price")} as r2, {pct("profit_margin")} as r3,
        lead(close, 63) over ({W}) / close - 1 as fwd_ret from factors),
        p as (select *, (coalesce(r1, 0) + coalesce(r2, 0) + coalesce(r3, 0)) / nullif((r1 is not null)::int + (r2 is not null)::int + (r3 is not null)::int, 0) as score from fr)"""
    + booked(("p", "score is not null and fwd_ret is not null"), 63, 1 / 3, 2 / 3, 12)
    + costs(2e6, 5.0, 0.025),
    "cost_functions": """with o as (select o_orderkey, o_totalprice / 1e7 - 0.001::double as p from orders),
        i as (select o_orderkey, p, 0.02::double * sqrt(greatest(p, 0.0::double)) * 1e4 as impact from o)
        select o_orderkey, round(impact, 6) as impact, round(2 * (10 + impact), 6) as round_trip, round(0.01::double - least(p * 10, 1.0::double) * (10 + impact) / 1e4, 6) as net from i""",
    "sharpe_summary": f"{SUMMARY} select n, {cols('mean', 'sharpe', 'skew', 'kurt')} from summ",
    "psr": f"{SUMMARY} select n, round({psr_sql('sharpe', lit(0), 'nd', 'skew', 'kurt')}, 6) as psr from summ",
    "dsr": f"""{SUMMARY}, tr as (select count(*)::double as _n, var_samp(v) as _var from (values {", ".join(f"({v!r}::double)" for _, v in SEEDS)}) t(v)),
        st as (select summ.*, {expected_best_sql("_var", "_n")} as sr_star from summ cross join tr)
        select n, round(sr_star, 6) as sr_star, round({psr_sql("sharpe", "sr_star", "nd")}, 6) as dsr from st""",
    "path_dispersion": f"""{BASE}, {SCORED}, rk as (select *, {avg_rank("score", "ticker")} as r from scored),
        a as (select ticker, sum(label)::double as n1, count(*) - sum(label)::double as n0, sum(case when label = 1 then r end) as s from rk group by ticker),
        b as (select (s - n1 * (n1 + 1) / 2) / nullif(n1 * n0, 0) as auc from a)
        select round(avg(auc), 6) as mean, round(stddev_pop(auc), 6) as std, round(min(auc), 6) as low, round(max(auc), 6) as high, round(avg((auc > 0.5)::int::double), 6) as above_half from b""",
    "auc_mann_whitney": f"""{BASE}, {SCORED}, rk as (select *, {avg_rank("score", "1")} as r from scored),
        a as (select sum(label)::double as n1, count(*) - sum(label)::double as n0, sum(case when label = 1 then r end) as s, count(*) as n from rk)
        select round((s - n1 * (n1 + 1) / 2) / nullif(n1 * n0, 0), 6) as auc, n from a""",
    "accuracy": f"{BASE}, {SCORED} select round(avg(((score >= 0.5)::int = label)::int::double), 6) as accuracy, round(avg(label::double), 6) as base_rate from scored",
    "spearman_ic": f"""{BASE}, {SCORED}, rk as (select date, {avg_rank("score", "date")} as a, {avg_rank("fwd_ret", "date")} as b from scored)
        select date, round(corr(a, b), 6) as ic, count(*) as n from rk group by date having count(*) >= 12 and corr(a, b) is not null and not isnan(corr(a, b))""",
    "relevance_qcut": f"""{BASE}, f as (select ticker, date, lead(close, 63) over ({W}) / close - 1 as fwd from x),
        r as (select ticker, date, row_number() over (partition by date order by fwd, ticker, date) as r, count(*) over (partition by date) as n from f where fwd is not null)
        select ticker, date, greatest(coalesce(ceil((r - 1) * 5 / nullif(n - 1, 0)::double) - 1, 0), 0)::bigint as relevance from r""",
    "trials_upsert": f"""with new as (select 'L' || n_nationkey as name, n_regionkey / 10.0::double as sharpe from nation where n_nationkey in (2, 3, 7)),
        old as (select 'L0' as name, 0.5::double as sharpe union all select * from (values {", ".join(f"('{n}', {v!r}::double)" for n, v in SEEDS if n != "L0")}) t(name, sharpe))
        select * from new union all select * from old where name not in (select name from new)""",
    "fixed_width_scan": f"{BASE} select ticker, date, cast(round(close * 100) as bigint) / 100.0::double as close, volume::bigint as volume from bars",
    "rest_scan": f"{BASE} select ticker, date, open, close, volume from bars",
    "json_scan": f"{BASE} select ticker, date, close, volume from bars",
    "event_props": "select event_id, (props->>'$.k')::bigint as k from events",
}


ORACLES["mean_t_stat"] = ORACLES["path_dispersion"].rpartition("select round(avg(auc)")[0] + "select round(avg(auc) / (stddev_samp(auc) / sqrt(count(auc)::double)), 6) as t, count(auc) as n from b"
ORACLES["cpcv_results"] = f"{CPCV} select split_id, n, rebalances, {cols('auc', 'sharpe', 'sharpe_gross', 'sharpe_net')} from per_split"
ORACLES["cpcv_evaluation"] = f"""{CPCV}, mean_sr as (select avg(sharpe) as sharpe from per_split), pooled as (select ls from sens where ls is not null),
    shape as (select skewness(ls) as skew, kurtosis(ls) + 3 as kurt from pooled),
    ne as (select greatest(count(distinct date) // 10, 1)::bigint as n_eff from te),
    tr as (select count(*) as trials, count(*)::double as _n, var_samp(v) as _var from (select sharpe as v from mean_sr union all select * from (values {", ".join(f"({v!r}::double)" for _, v in SEEDS)}) t(v))),
    one as (select 'momentum' as config, avg(auc) as auc, stddev_pop(auc) as auc_std, min(auc) as auc_low, max(auc) as auc_high, avg((auc > 0.5)::int::double) as above_half, avg(sharpe) as sharpe,
      stddev_pop(sharpe) as sharpe_std, avg(sharpe_gross) as sharpe_gross, avg(sharpe_net) as sharpe_net, count(auc) as splits from per_split),
    al as (select *, n_eff::double as nd, {expected_best_sql("_var", "_n")} as sr_star from one cross join shape cross join ne cross join tr)
    select config, splits, n_eff, trials, {cols('auc', 'auc_std', 'auc_low', 'auc_high', 'above_half', 'sharpe', 'sharpe_std', 'sharpe_gross', 'sharpe_net', 'skew', 'kurt')},
      round({psr_sql("sharpe", "sr_star", "nd", "skew", "kurt")}, 6) as dsr from al"""
_TILT = ORACLES["fundamental_tilt"].rpartition("select date, round(gross, 6) as gross")[0]
ORACLES["tilt_summary"] = f"""{_TILT.rstrip()}, tilt as (select gross, gross - coalesce(cost, 0) as net from earned left join paid using (k)),
    summ as (select count(*) as n, count(*)::double as nd, avg(gross) / nullif(stddev_samp(gross), 0) as sharpe_gross, avg(net) / nullif(stddev_samp(net), 0) as sharpe, skewness(net) as skew, kurtosis(net) + 3 as kurt from tilt),
    tr as (select count(*)::double as _n, var_samp(v) as _var from (select sharpe as v from summ union all select * from (values {", ".join(f"({v!r}::double)" for _, v in SEEDS)}) t(v))),
    al as (select *, {expected_best_sql("_var", "_n")} as sr_star from summ cross join tr)
    select n as rebalances, round(sharpe_gross, 6) as sharpe_gross, round(sharpe, 6) as sharpe_net, round(sharpe * 2.0::double, 6) as annualised,
      round({psr_sql("sharpe", lit(0), "nd", "skew", "kurt")}, 6) as psr, round({psr_sql("sharpe", "sr_star", "nd")}, 6) as dsr, sharpe > 0 as success from al"""
ORACLES["quarterly_panel"] = f"""{BASE}{ASOF}, v as (select *, close / lag(close, 21) over ({W}) - 1 as mom_21, {roll("stddev_samp", "lr", 21)} as vol_21, lead(close, 63) over ({W}) / close - 1 as fwd_ret from factors),
    r as (select *, {pct("mom_21")} as mom_21_rank, {pct("vol_21")} as vol_21_rank from v),
    grid as (select date from (select date, row_number() over (order by date) - 1 as pos from (select distinct date from bars)) where pos % 63 = 0)
    select ticker, date, {cols("fwd_ret", "mom_21", "mom_21_rank", "vol_21", "vol_21_rank", "earnings_yield", "book_to_price", "profit_margin", "div_yield")} from r where date in (select date from grid)
      and fwd_ret is not null and mom_21 is not null and vol_21 is not null and earnings_yield is not null and book_to_price is not null and profit_margin is not null and div_yield is not null"""


def _matrix() -> str:
    parts = ("triple_barrier", "fracdiff_close", "fracdiff_vol", "rsi", "momentum", "amihud", "roll_spread", "dollar_vol_z", "turnover_accel", "cusum_vol", "explosivity", "vol_regime", "fund_factors", "cs_pct_rank")
    names = "label fd_close fd_vol21 rsi_14 mom_21 amihud roll_spread dollar_vol_z turnover_accel cusum_vol explosivity vol_regime earnings_yield book_to_price profit_margin div_yield mom_5_rank mom_21_rank"
    joined = " join ".join(f"({ORACLES[p]}) t{i}" + (" using (ticker, date)" if i else "") for i, p in enumerate(parts))
    return f"select ticker, date, {', '.join(names.split())} from {joined}"


ORACLES["feature_matrix"] = _matrix()
