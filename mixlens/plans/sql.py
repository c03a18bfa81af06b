"""DuckDB oracle SQL for the registered queries.

Each string recomputes a query from the raw parquet views (lineitem, orders)
with plain SQL: window frames, GROUP BY and, for adstock, an exact recursive
CTE (no truncation), so it checks the Spark plans independently.  Doubles are
rounded (see context.rounded); integer literals are cast to double where Spark has doubles.
"""

from __future__ import annotations

from mixlens.operators.contribution import REBASE_GROUPS
from mixlens.operators.features import SESSIONS_TERMS, BOOKINGS_TERMS
from mixlens.sources.tables import DRIVER_GROUPS, DRIVER_ORDER, TERM_GROUPS

D1, D0 = "cast(1 as double)", "cast(0 as double)"


def r6(expr: str, digits: int = 8) -> str:
    """Same rounding as ``context.rounded``: snap to 2^-24, then 8 significant
    digits but nothing finer than 1e-9, using exact powers of ten."""
    v = f"(round_even(({expr}) * 16777216, 0) / 16777216)"
    e = f"greatest(floor(log10(abs({v}))) - {digits - 1}, -9)"
    return (f"(case when {v} is null then null when {v} = 0 then {D0} "
            f"when {e} < 0 then round_even({v} * pow(10, -{e}), 0) / pow(10, -{e}) "
            f"else round_even({v} / pow(10, {e}), 0) * pow(10, {e}) end + {D0})")


def z(col: str, part: str = "partition by product_id") -> str:
    """Z-score over the partition, sample SD; NULL stays NULL, constant -> 0."""
    return (f"(case when {col} is null then null else coalesce(({col} - avg({col}) over ({part})) "
            f"/ nullif(stddev_samp({col}) over ({part}), 0), {D0}) end)")


PANEL = """product_series as (
  select cast(l_suppkey as varchar) as product_id, cast(l_shipdate as date) as date,
         cast(sum(l_quantity) as bigint) as sessions, count(*) as bookings
  from lineitem group by 1, 2)"""

META = """meta_series as (
  select cast(o_orderdate as date) as date,
         coalesce(sum(case when o_orderpriority = '1-URGENT' then o_totalprice end), 0) / 1000 as tv_ad_reach,
         avg(o_totalprice) / 1000 as consumer_confidence_index,
         avg(case when o_orderstatus = 'F' then o_totalprice end) / 1000 as exchange_rate,
         cast(count(*) as double) as online_visibility,
         case min(o_orderkey) % 3 when 0 then 'average' when 1 then 'better than average'
              else 'worse than average' end as weather_index
  from orders group by 1)"""

TRAIN = "panel_train as (select * from product_series where date <= date '1999-12-31')"

TRAIN_TOTAL = """panel_train_total as (
  select product_id, date, sessions, bookings from panel_train
  union all
  select 'Total', date, cast(sum(sessions) as bigint), cast(sum(bookings) as bigint) from panel_train group by date)"""


def drivers(src: str = "panel_train", name: str = "panel_drivers") -> str:
    return f"""{name} as (
  select p.product_id, p.date, p.sessions, p.bookings, m.tv_ad_reach, m.consumer_confidence_index,
         m.exchange_rate, m.online_visibility, m.weather_index,
         case when m.weather_index = 'average' then {D1} else {D0} end as average_weather_days,
         case when m.weather_index = 'better than average' then {D1} else {D0} end as better_than_average_weather_days,
         case when m.weather_index = 'worse than average' then {D1} else {D0} end as worse_than_average_weather_days
  from {src} p left join meta_series m on p.date = m.date)"""


DRIVERS = drivers()


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ",\n".join(ctes) + "\n"


def adstock_ctes(src: str, x: str, rate_sql: str = "0.8", keys: str = "product_id",
                 rates: tuple[float, ...] | None = None, pre: str = "ad", strict: bool = False) -> list[str]:
    """Exact recursion a_1 = x_1, a_i = x_i + r a_(i-1) per key, in date order
    (a missing x is 0; with ``strict`` it stays missing, and all after it).
    Produces CTE ``{pre}_rows`` (keys, [rate,] date, rn, a)."""
    key_list = [k.strip() for k in keys.split(",")]
    if rates:
        vals = ", ".join(f"(cast({r!r} as double))" for r in rates)
        base = (f"{pre}_src as materialized (select {keys}, rt.rate, date, coalesce({x}, 0) as x, "
                f"row_number() over (partition by {keys}, rt.rate order by date) as rn "
                f"from {src}, (values {vals}) rt(rate))")
        k2 = key_list + ["rate"]
        rate_expr = "s.rate"
    else:
        base = (f"{pre}_src as materialized (select {keys}, date, {x if strict else f'coalesce({x}, 0)'} as x, "
                f"row_number() over (partition by {keys} order by date) as rn from {src})")
        k2 = key_list
        rate_expr = rate_sql
    on = " and ".join(f"s.{k} = {pre}.{k}" for k in k2)
    cols = ", ".join(k2)
    rec = (f"{pre}({cols}, rn, a) as (select {cols}, rn, x from {pre}_src where rn = 1 union all "
           f"select {', '.join('s.' + k for k in k2)}, s.rn, s.x + {rate_expr} * {pre}.a from {pre} join {pre}_src s "
           f"on {on} and s.rn = {pre}.rn + 1)")
    rows = (f"{pre}_rows as (select {', '.join('s.' + k for k in k2)}, s.date, s.rn, {pre}.a from {pre}_src s join {pre} "
            f"on {on} and s.rn = {pre}.rn)")
    return [base, rec, rows]


# ------------------------------------------------------------------ exploration
PRODUCT_COUNT = with_(PANEL) + "select count(distinct product_id) as n_products from product_series"

DAILY_METRICS_LONG = with_(PANEL, "d as (select date, sum(sessions) as s, sum(bookings) as b from product_series group by date)") + """
select date, 'sessions' as metric, cast(s as double) as value from d
union all select date, 'bookings' as metric, cast(b as double) as value from d"""

DAILY_CONVERSION = with_(PANEL) + f"""
select date, cast(sum(sessions) as bigint) as sessions, cast(sum(bookings) as bigint) as bookings,
       {r6('cast(sum(bookings) as double) / nullif(cast(sum(sessions) as double), 0)')} as conv_rate
from product_series group by date"""

DAILY_CONVERSION_LONG = with_(PANEL, """d as (select date, cast(sum(sessions) as double) as s, cast(sum(bookings) as double) as b
  from product_series group by date)""") + f"""
select date, 'sessions' as metric, s as value from d union all select date, 'bookings', b from d
union all select date, 'conv_rate', {r6('b / nullif(s, 0)')} from d"""

PRODUCT_SERIES_LONG = with_(PANEL) + """
select product_id, date, 'sessions' as metric, cast(sessions as double) as value from product_series
union all select product_id, date, 'bookings' as metric, cast(bookings as double) as value from product_series"""

PRODUCT_TOTALS_LONG = with_(PANEL, "t as (select product_id, sum(sessions) as s, sum(bookings) as b from product_series group by product_id)") + """
select product_id, 'sessions' as metric, cast(s as double) as value from t
union all select product_id, 'bookings' as metric, cast(b as double) as value from t"""

DATE_BOUNDS = with_(PANEL) + "select min(date) as date_from, max(date) as date_to from product_series"

_PROFILE_COLS = ["date", "product_id", "sessions", "bookings", "tv_ad_reach", "consumer_confidence_index",
                 "exchange_rate", "online_visibility", "weather_index", "average_weather_days",
                 "better_than_average_weather_days", "worse_than_average_weather_days"]
PANEL_PROFILE = with_(PANEL, META, TRAIN, DRIVERS) + "\nunion all\n".join(
    f"select '{c}' as column_name, count(*) as n_rows, count({c}) as n_non_null, count(*) - count({c}) as n_null "
    f"from panel_drivers" for c in _PROFILE_COLS)

# ------------------------------------------------------------------ CSV front door
PANEL_FROM_CSV = with_(PANEL) + "select * from product_series"

META_FROM_CSV = with_(META) + "select date, " + ", ".join(f"{r6(c)} as {c}" for c in (
    "tv_ad_reach", "consumer_confidence_index", "exchange_rate", "online_visibility")) + ", weather_index from meta_series"

CSV_REJECTS = with_(PANEL) + """
select 'sessions' as column, 'not_bigint' as reason, 'n/a' as value, count(*) as n from product_series where day(date) = 1
union all
select 'date', 'not_date', cast(date as varchar) || '?', count(*) from product_series where day(date) = 2 group by date"""

# ------------------------------------------------------------------ panel build
TOTAL_LAYER = with_(PANEL) + """
select product_id, date, sessions, bookings from product_series
union all
select 'Total' as product_id, date, cast(sum(sessions) as bigint), cast(sum(bookings) as bigint)
from product_series group by date"""

PANEL_WITH_DRIVERS = with_(PANEL, META, TRAIN, TRAIN_TOTAL, drivers("panel_train_total")) + f"""
select product_id, date, sessions, bookings, {r6('tv_ad_reach')} as tv_ad_reach,
       {r6('consumer_confidence_index')} as consumer_confidence_index, {r6('exchange_rate')} as exchange_rate,
       {r6('online_visibility')} as online_visibility, weather_index, average_weather_days,
       better_than_average_weather_days, worse_than_average_weather_days
from panel_drivers"""

WEATHER_ONEHOT = with_(META) + f"""
select date, weather_index,
       case when weather_index = 'average' then {D1} else {D0} end as average_weather_days,
       case when weather_index = 'better than average' then {D1} else {D0} end as better_than_average_weather_days,
       case when weather_index = 'worse than average' then {D1} else {D0} end as worse_than_average_weather_days
from meta_series"""

_XMAS = ", ".join(f"date '{y}-12-25'" for y in range(1995, 2000))

EVENT_DUMMY = with_(PANEL, TRAIN) + f"""
select product_id, date, case when date in ({_XMAS}) then {D1} else {D0} end as xmas from panel_train"""

_CAMPAIGN = ", ".join(f"date '{y}-{d}'" for y in range(1995, 2000) for d in ("05-01", "11-27"))
EVENT_DUMMY_MARKET = with_(PANEL, TRAIN, """markets as (
  select cast(s_suppkey as varchar) as product_id, min(n_name) as market
  from supplier left join nation on s_nationkey = n_nationkey group by 1)""") + f"""
select p.product_id, date, market,
  case when date in ({_CAMPAIGN}) and market in ('NATION_3', 'NATION_7', 'NATION_12') then {D1} else {D0} end as campaign
from panel_train p left join markets m on p.product_id = m.product_id"""

# ------------------------------------------------------------------ series windows
ADSTOCK_TV = with_(PANEL, META, TRAIN, DRIVERS, *adstock_ctes("panel_drivers", "tv_ad_reach"),
                   recursive=True) + f"select product_id, date, {r6('a')} as tv_adstock from ad_rows"

DECAY = (0.1, 0.5, 0.8, 0.9)
ADSTOCK_MULTI_RATE = with_(PANEL, META, TRAIN, DRIVERS, *adstock_ctes("panel_drivers", "tv_ad_reach", rates=DECAY),
                           recursive=True) + f"select product_id, date, rate, {r6('a')} as adstock from ad_rows"

FX_ROLLING_MEAN = with_(PANEL, META, TRAIN, DRIVERS, """f as (
  select product_id, date, row_number() over (partition by product_id order by date) as rn,
         avg(exchange_rate) over (partition by product_id order by date rows between 9 preceding and current row) as m
  from panel_drivers)""") + f"""
select product_id, date,
       {r6('case when rn >= 10 then m else max(case when rn = 10 then m end) over (partition by product_id) end')}
         as exchange_rate_moving_av
from f"""

CENTERED_MEAN_EXTEND = with_(PANEL, TRAIN, """c as (
  select product_id, date, row_number() over (partition by product_id order by date) as rn,
         count(*) over (partition by product_id) as n,
         avg(cast(sessions as double)) over (partition by product_id order by date
                                             rows between 3 preceding and 3 following) as m
  from panel_train)""") + f"""
select product_id, date, {r6('''case when n < 7 then null
  when rn < 4 then max(case when rn = 4 then m end) over (partition by product_id)
  when rn > n - 3 then max(case when rn = n - 3 then m end) over (partition by product_id)
  else m end''')} as sessions_smooth
from c"""

LAG_TREND = with_(PANEL, META, TRAIN, DRIVERS) + f"""
select product_id, date,
       {r6('lag(exchange_rate) over (partition by product_id order by date)')} as exchange_rate_lag1,
       row_number() over (partition by product_id order by date) as trend
from panel_drivers"""

ZSCORE_BY_PRODUCT = with_(PANEL, TRAIN) + f"""
select product_id, date, {r6(z('cast(sessions as double)'))} as sessions_z,
       {r6(z('cast(bookings as double)'))} as bookings_z
from panel_train"""

INTERPOLATED_FX = with_(PANEL, META, TRAIN, DRIVERS, """i as (
  select product_id, date, exchange_rate as x,
         row_number() over (partition by product_id order by date) as rn
  from panel_drivers)""", """j as (
  select *,
    last_value(x ignore nulls) over (partition by product_id order by rn rows between unbounded preceding and current row) as pv,
    last_value(case when x is not null then rn end ignore nulls) over (partition by product_id order by rn rows between unbounded preceding and current row) as pr,
    first_value(x ignore nulls) over (partition by product_id order by rn rows between current row and unbounded following) as nv,
    first_value(case when x is not null then rn end ignore nulls) over (partition by product_id order by rn rows between current row and unbounded following) as nr
  from i)""") + f"""
select product_id, date, {r6('x')} as exchange_rate,
       {r6('case when x is not null then x when pv is null then nv when nv is null then pv '
           'else pv + (nv - pv) * (cast(rn - pr as double) / cast(nr - pr as double)) end')} as exchange_rate_filled
from j"""

REBASE_SESSIONS = with_(PANEL, TRAIN) + f"""
select product_id, date,
       {r6('cast(sessions as double) + min(cast(bookings as double)) over (partition by product_id)')} as base,
       {r6('cast(bookings as double) - min(cast(bookings as double)) over (partition by product_id)')} as bookings
from panel_train"""

# one series over all of lineitem; 200 rows back an input's weight is 0.8^200 = 4e-20
LONG_SERIES = f"""with l as (
  select l_orderkey, l_linenumber, l_quantity as x, case when l_returnflag = 'R' then l_extendedprice end as y,
         row_number() over w as rn, count(*) over () as n,
         list(cast(l_quantity as double)) over (w rows between 200 preceding and current row) as xs,
         avg(l_extendedprice) over (w rows between 9 preceding and current row) as m10,
         avg(l_extendedprice) over (w rows between 3 preceding and 3 following) as m7,
         lag(l_extendedprice) over w as before
  from lineitem window w as (order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)),
c as (select *,
    last_value(y ignore nulls) over (order by rn rows between unbounded preceding and current row) as pv,
    last_value(case when y is not null then rn end ignore nulls) over (order by rn rows between unbounded preceding and current row) as pr,
    first_value(y ignore nulls) over (order by rn rows between current row and unbounded following) as nv,
    first_value(case when y is not null then rn end ignore nulls) over (order by rn rows between current row and unbounded following) as nr
  from l)
select cast(l_orderkey as bigint) as l_orderkey, cast(l_linenumber as bigint) as l_linenumber, rn as trend,
  {r6('list_reduce(xs, lambda s, v: s * 0.8 + v)')} as quantity_adstock,
  {r6('case when rn >= 10 then m10 else (select m10 from l where rn = 10) end')} as price_mean10,
  {r6('case when n < 7 then null when rn < 4 then (select m7 from l where rn = 4) when rn > n - 3 then (select m7 from l where rn = n - 3) else m7 end')} as price_smooth,
  {r6('before')} as price_lag1,
  {r6('case when y is not null then y when pv is null then nv when nv is null then pv '
      'else pv + (nv - pv) * (cast(rn - pr as double) / cast(nr - pr as double)) end')} as returned_price,
  {r6('(x - avg(x) over ()) / stddev_samp(x) over ()')} as quantity_z
from c"""

# ------------------------------------------------------------------ scalar features
WEEKDAY_FLAGS = with_(META) + f"""
select date,
       case when dayofweek(date) = 5 then {D1} else {D0} end as day_friday,
       case when dayofweek(date) = 6 then {D1} else {D0} end as day_saturday,
       case when dayofweek(date) = 0 then {D1} else {D0} end as day_sunday,
       cast(dayofmonth(date) as bigint) as day_number, monthname(date) as month,
       cast(year(date) as bigint) as year
from meta_series"""

POWER_LOG_FEATURES = with_(META) + f"""
select date, {r6('ln(1 + tv_ad_reach)')} as tv_log1p, {r6('pow(online_visibility, 2)')} as online_visibility_exp
from meta_series"""

CHRISTMAS_FLAG = with_(META) + f"""
select date, case when date in ({_XMAS}) then {D1} else {D0} end as xmas from meta_series"""


# ------------------------------------------------------------------ features
def _raw_select(friday_dow: int = 5) -> str:
    return f"""select product_id, date, cast(sessions as double) as y_sessions, cast(bookings as double) as y_bookings,
       case when dayofweek(date) = {friday_dow} then {D1} else {D0} end as day_friday,
       case when dayofweek(date) = 6 then {D1} else {D0} end as day_saturday,
       case when dayofweek(date) = 0 then {D1} else {D0} end as day_sunday,
       ln(1 + a) as tv_adstock, consumer_confidence_index,
       case when rn >= 10 then fx_m else max(case when rn = 10 then fx_m end) over (partition by product_id) end
         as exchange_rate_moving_av,
       online_visibility, pow(online_visibility, 2) as online_visibility_exp,
       better_than_average_weather_days, worse_than_average_weather_days"""


def design_ctes(friday_dow: int = 5, src: str = "panel_drivers", strict: bool = False) -> list[str]:
    """CTE ``raw_design``: unscaled design rows of the product fits (date <= train end)."""
    return [
        *adstock_ctes(src, "tv_ad_reach", strict=strict),
        f"""f1 as (select d.*, r.a, r.rn,
  avg(d.exchange_rate) over (partition by d.product_id order by d.date rows between 9 preceding and current row) as fx_m
  from {src} d join ad_rows r on d.product_id = r.product_id and d.date = r.date)""",
        f"raw_design as ({_raw_select(friday_dow)} from f1)",
    ]


def scaled_cte(terms: tuple[str, ...], fit_from: str | None, name: str = "scaled",
               target: str = "sessions") -> str:
    cols = ", ".join(f"{t} as {t}" if t == "tv_adstock" else f"{z(t)} as {t}" for t in terms)
    inner = f"select product_id, date, y_{target} as dep_var, {cols} from raw_design"
    where = f" where date >= date '{fit_from}'" if fit_from else ""
    return f"{name} as (select * from ({inner}){where})"


def _feature_sql(target: str, terms: tuple[str, ...], fit_from: str | None, friday_dow: int = 5) -> str:
    head = with_(PANEL, META, TRAIN, DRIVERS, *design_ctes(friday_dow), scaled_cte(terms, fit_from, target=target),
                 recursive=True)
    return head + "select product_id, date, " + ", ".join(r6(c) + f" as {c}" for c in ("dep_var",) + terms) + " from scaled"


FEATURES_SESSIONS = _feature_sql("sessions", SESSIONS_TERMS, None)
FEATURES_BOOKINGS = _feature_sql("bookings", BOOKINGS_TERMS, "1998-01-01")
# the reference's literal set-up flags Wednesday (DuckDB dayofweek 3) as 'Friday'
FEATURES_SESSIONS_COMPAT = _feature_sql("sessions", SESSIONS_TERMS, None, friday_dow=3)

FEATURES_SESSIONS_STRICT = with_(
    PANEL, META.replace("meta_series as", "known_series as", 1),
    "meta_series as (select * replace (nullif(tv_ad_reach, 0) as tv_ad_reach) from known_series)",
    TRAIN, DRIVERS, *design_ctes(strict=True), scaled_cte(SESSIONS_TERMS, None), recursive=True) + \
    "select product_id, date, " + ", ".join(r6(c) + f" as {c}" for c in ("dep_var",) + SESSIONS_TERMS) + " from scaled"

_H_TERMS = tuple(dict.fromkeys(SESSIONS_TERMS + BOOKINGS_TERMS))


def _meta_design() -> list[str]:
    return [
        "h0 as materialized (select *, 0 as g from meta_series)",
        *adstock_ctes("h0", "tv_ad_reach", keys="g", pre="had"),
        "h1 as (select h0.*, had_rows.rn, had_rows.a from h0 join had_rows on h0.date = had_rows.date)",
        f"""h2 as (select *,
   avg(exchange_rate) over (order by rn rows between 9 preceding and current row) as fx_m,
   case when weather_index = 'better than average' then {D1} else {D0} end as better_than_average_weather_days,
   case when weather_index = 'worse than average' then {D1} else {D0} end as worse_than_average_weather_days
  from h1)""",
        f"""hraw as (select date,
   case when dayofweek(date) = 5 then {D1} else {D0} end as day_friday,
   case when dayofweek(date) = 6 then {D1} else {D0} end as day_saturday,
   case when dayofweek(date) = 0 then {D1} else {D0} end as day_sunday,
   ln(1 + a) as tv_adstock, consumer_confidence_index,
   case when rn >= 10 then fx_m else max(case when rn = 10 then fx_m end) over () end as exchange_rate_moving_av,
   online_visibility, pow(online_visibility, 2) as online_visibility_exp,
   better_than_average_weather_days, worse_than_average_weather_days
  from h2)""",
    ]


FEATURES_HORIZON = with_(META, *_meta_design(), recursive=True) + "select * from (select date, " + ", ".join(
    f"{r6(z(t, ''))} as {t}" for t in _H_TERMS) + " from hraw) where date >= date '2000-01-01'"

_V9_TERMS = tuple(t for t in BOOKINGS_TERMS if not t.startswith("day_"))
SCALED_DRIVERS_LONG = with_(META, *_meta_design(), "hs as (select date, " + ", ".join(
    f"{z(t, '')} as {t}" for t in _V9_TERMS) + " from hraw)", recursive=True) + "\nunion all\n".join(
    f"select date, '{t}' as variable, {r6(t)} as value from hs" for t in _V9_TERMS)

DRIVER_OVERLAY = with_(PANEL, META, TRAIN, DRIVERS, *design_ctes(), recursive=True) + f"""
select product_id, date, {r6(z('y_sessions'))} as dep_var_z, {r6(z('tv_adstock'))} as variable_z from raw_design"""

# ------------------------------------------------------------------ regression
_X = [D1] + list(SESSIONS_TERMS)
_P = len(_X)
_ENTRIES = [f"sum({_X[i]} * {_X[j]})" for i in range(_P) for j in range(i, _P)] + \
           [f"sum({_X[i]} * dep_var)" for i in range(_P)]
_CC = " and ".join(f"{c} is not null" for c in ("dep_var",) + SESSIONS_TERMS)
GRAM_BY_PRODUCT = with_(PANEL, META, TRAIN, DRIVERS, *design_ctes(), scaled_cte(SESSIONS_TERMS, None),
                        f"""g as (select product_id, count(*) as n, sum(dep_var * dep_var) as yty, sum(dep_var) as sum_y,
  [{', '.join(_ENTRIES)}] as vals from scaled where {_CC} group by product_id)""", recursive=True) + f"""
select product_id, n, {r6('yty')} as yty, {r6('sum_y')} as sum_y, entry, {r6('value')} as value
from (select product_id, n, yty, sum_y, unnest(range({len(_ENTRIES)})) as entry, unnest(vals) as value from g)"""

SINGLE_DRIVER_FIT = with_(PANEL, META, TRAIN, DRIVERS, *design_ctes(), recursive=True) + f"""
select product_id, cast(regr_count(y_sessions, tv_adstock) as bigint) as n,
       {r6('regr_slope(y_sessions, tv_adstock)')} as slope, {r6('regr_intercept(y_sessions, tv_adstock)')} as intercept,
       {r6('regr_r2(y_sessions, tv_adstock)')} as r_squared
from raw_design group by product_id"""

# ------------------------------------------------------------------ segmentation
_UPLIFT = ("cast(sum(case when year(date) = 1999 then sessions else 0 end) as double) / "
           "nullif(cast(sum(case when year(date) = 1997 then sessions else 0 end) as double), 0)")
PRODUCT_STATS = with_(PANEL, TRAIN) + f"""
select product_id, {r6('cast(sum(sessions) as double)')} as n_total_sessions,
       {r6('cast(sum(bookings) as double)')} as n_total_bookings,
       {r6('stddev_samp(sessions)')} as sd_total_sessions, {r6('stddev_samp(bookings)')} as sd_total_bookings,
       {r6('avg(cast(bookings as double) / nullif(cast(sessions as double), 0))')} as av_conv_rate,
       {r6(_UPLIFT)} as uplift
from panel_train group by product_id"""

UPLIFT = with_(PANEL, TRAIN) + f"select product_id, {r6(_UPLIFT)} as uplift from panel_train group by product_id"

# ------------------------------------------------------------------ transform search
TRANSFORM_GRID = with_(PANEL, META, TRAIN, DRIVERS, *adstock_ctes("panel_drivers", "tv_ad_reach", rates=DECAY),
                       """g as (select r.product_id, r.rate, regr_r2(cast(d.sessions as double), ln(1 + r.a)) as r_squared,
       regr_slope(cast(d.sessions as double), ln(1 + r.a)) as slope
  from ad_rows r join panel_drivers d on r.product_id = d.product_id and r.date = d.date
  group by r.product_id, r.rate)""", recursive=True) + f"""
select product_id, rate, {r6('r_squared')} as r_squared, {r6('slope')} as slope,
       row_number() over (partition by product_id order by r_squared desc nulls last, rate asc) as rank
from g"""


# ------------------------------------------------------------------ per-product OLS in SQL
# Gauss-Jordan elimination on the Gram system [X'X | X'y | I], generated as one
# CTE per pivot.  A pivot whose remaining diagonal is <= 1e-7 x its original
# diagonal is skipped (term aliased, coefficient NULL), as in the Spark solve.
ALIAS_TOL = "1e-7"

_GROUPS, _ORDER, _TERM_GROUP, _REBASED = DRIVER_GROUPS, DRIVER_ORDER, TERM_GROUPS, REBASE_GROUPS


def _cc(terms) -> str:
    return " and ".join(f"{c} is not null" for c in ("dep_var",) + tuple(terms))


def ols_ctes(terms: tuple[str, ...], src: str, pre: str) -> list[str]:
    """CTEs ending in ``{pre}m``: product_id, n, rank, status, mean_y, beta_i, inv_i."""
    x = [D1] + list(terms)
    p = len(x)
    cols = ["product_id", "count(*) as n", "sum(dep_var) as sy"]
    for i in range(p):
        for j in range(p):
            a, b = min(i, j), max(i, j)
            cols.append(f"sum({x[a]} * {x[b]}) as a_{i}_{j}")
        cols.append(f"sum({x[i]} * dep_var) as b_{i}")
        for j in range(p):
            cols.append(f"{D1 if i == j else D0} as e_{i}_{j}")
        cols.append(f"sum({x[i]} * {x[i]}) as d_{i}")
    ctes = [f"{pre}0 as (select {', '.join(cols)} from {src} where {_cc(terms)} group by product_id)"]
    carry = ["product_id", "n", "sy"] + [f"d_{i}" for i in range(p)]
    for k in range(p):
        keep = f"(a_{k}_{k} > {ALIAS_TOL} * d_{k})"
        f = lambda i: f"(case when {keep} then a_{i}_{k} / a_{k}_{k} else {D0} end)"
        sel = list(carry) + [f"kp_{j}" for j in range(k)] + [f"{keep} as kp_{k}"]
        for i in range(p):
            for j in range(p):
                sel.append(f"a_{i}_{j}" if i == k else f"a_{i}_{j} - {f(i)} * a_{k}_{j} as a_{i}_{j}")
            sel.append(f"b_{i}" if i == k else f"b_{i} - {f(i)} * b_{k} as b_{i}")
            for j in range(p):
                sel.append(f"e_{i}_{j}" if i == k else f"e_{i}_{j} - {f(i)} * e_{k}_{j} as e_{i}_{j}")
        ctes.append(f"{pre}{k + 1} as (select {', '.join(sel)} from {pre}{k})")
    rank = " + ".join(f"cast(kp_{k} as integer)" for k in range(p))
    fin = [f"product_id, n, cast({rank} as integer) as rank, sy / n as mean_y"]
    for k in range(p):
        fin.append(f"case when kp_{k} then b_{k} / a_{k}_{k} end as beta_{k}")
        fin.append(f"case when kp_{k} then e_{k}_{k} / a_{k}_{k} end as inv_{k}")
    ctes.append(f"{pre}f as (select {', '.join(fin)} from {pre}{p})")
    betas = ", ".join(f"case when n > rank then beta_{k} end as beta_{k}" for k in range(p))
    invs = ", ".join(f"inv_{k}" for k in range(p))
    ctes.append(f"{pre}m as (select product_id, n, rank, case when n > rank then 'ok' else 'too_few_rows' end as status, "
                f"mean_y, {betas}, {invs} from {pre}f)")
    return ctes


def _fitted(terms) -> str:
    x = [D1] + list(terms)
    return " + ".join(f"coalesce(m.beta_{i}, {D0}) * {x[i] if i == 0 else 's.' + x[i]}" for i in range(len(x)))


def model_head(target: str, terms, fit_from: str | None, extra: tuple[str, ...] = ()) -> str:
    """WITH clause ending with ``scaled`` (design) and ``om`` (models) for one target."""
    return with_(PANEL, META, TRAIN, DRIVERS, *design_ctes(), scaled_cte(terms, fit_from, target=target),
                 *ols_ctes(terms, "scaled", "o"), *extra, recursive=True)


_S_ARGS = ("sessions", SESSIONS_TERMS, None)
_B_ARGS = ("bookings", BOOKINGS_TERMS, "1998-01-01")


def _ols_long(target, terms, fit_from) -> str:
    names = ("intercept",) + tuple(terms)
    arms = "\nunion all\n".join(
        f"select '{target}' as target, product_id, status, rank, n, cast({i} as integer) as term_index, "
        f"'{t}' as term, {r6(f'beta_{i}')} as estimate from om" for i, t in enumerate(names))
    return model_head(target, terms, fit_from) + arms


OLS_SESSIONS = _ols_long(*_S_ARGS)
OLS_BOOKINGS = _ols_long(*_B_ARGS)

_OK_ROWS = lambda terms: (
    f"fr as (select s.*, m.mean_y, m.n as n_model, m.rank, {_fitted(terms)} as fitted "
    f"from scaled s join om m on s.product_id = m.product_id where m.status = 'ok' and "
    + " and ".join(f"s.{c} is not null" for c in ("dep_var",) + tuple(terms)) + ")")


def _quality_ctes(terms) -> tuple[str, ...]:
    return (_OK_ROWS(terms), """q as (select product_id, any_value(n_model) as n, any_value(rank) as rank,
  sum((dep_var - fitted) * (dep_var - fitted)) as rss, sum((dep_var - mean_y) * (dep_var - mean_y)) as tss
  from fr group by product_id)""")


def _quality_sql(args) -> str:
    return model_head(*args, extra=_quality_ctes(args[1])) + f"""
select '{args[0]}' as target, product_id, n, rank, {r6('rss')} as rss, {r6('tss')} as tss,
  {r6('1 - rss / nullif(tss, 0)')} as r_squared,
  {r6('1 - (rss / cast(n - rank as double)) / nullif(tss / (n - 1), 0)')} as adj_r_squared,
  {r6('((tss - rss) / cast(rank - 1 as double)) / nullif(rss / cast(n - rank as double), 0)')} as f_statistic,
  {r6('sqrt(rss / cast(n - rank as double))')} as sigma, {r6('sqrt(rss / n)')} as rmse
from q"""


MODEL_QUALITY = _quality_sql(_S_ARGS)
MODEL_QUALITY_BOOKINGS = _quality_sql(_B_ARGS)

RMSE_BY_PRODUCT = model_head(*_S_ARGS, extra=_quality_ctes(SESSIONS_TERMS)) + f"""
select 'sessions' as target, product_id, {r6('sqrt(rss / n)')} as rmse from q"""



def _actual_sql(args) -> str:
    return model_head(*args, extra=(_OK_ROWS(args[1]),)) + f"""
select product_id, date, {r6('dep_var')} as actual, {r6('fitted')} as fitted, {r6('dep_var - fitted')} as residual
from fr"""


ACTUAL_VS_MODEL = _actual_sql(_S_ARGS)
ACTUAL_VS_MODEL_BOOKINGS = _actual_sql(_B_ARGS)

_NAMES_S = ("intercept",) + SESSIONS_TERMS
COEF_TABLE = model_head(*_S_ARGS, extra=_quality_ctes(SESSIONS_TERMS)) + "\nunion all\n".join(
    f"select 'sessions' as target, m.product_id, cast({i} as integer) as term_index, '{t}' as term, "
    f"{r6(f'm.beta_{i}')} as estimate, {r6(f'sqrt(q.rss / cast(m.n - m.rank as double) * m.inv_{i})')} as std_error, "
    f"{r6(f'm.beta_{i} / nullif(sqrt(q.rss / cast(m.n - m.rank as double) * m.inv_{i}), 0)')} as t_value, "
    f"m.n - m.rank as df_resid from om m join q on m.product_id = q.product_id where m.status = 'ok'"
    for i, t in enumerate(_NAMES_S))




def _series_sql(t2: str, df: str) -> str:
    """The terms of the t distribution's finite series in one pass: sum before the
    N-th (head), the N-th (mid), sum from it on (tail)."""
    cell = "struct_pack(k := cast({k} as double), term := {t}, mid := cast(0 as double), head := cast(0 as double), tail := cast(0 as double))"
    n, x = f"floor({df} / 2)", f"({df} / ({df} + {t2}))"
    beyond = f"case when {t2} > 36 then ceil(least(37 * {df} / {t2}, 1e6)) + 60 else 0 end"
    steps = f"list_transform(range(1, cast({n} + {beyond} as bigint) + 2), lambda k: {cell.format(k='k', t='cast(0 as double)')})"
    return f"""list_reduce(list_prepend({cell.format(k='0', t='cast(1 as double)')}, {steps}), lambda s, e: struct_pack(
      k := e.k, term := s.term * ({x} * ((2 * e.k - 1 + {df} % 2) / (2 * e.k + {df} % 2))),
      mid := case when e.k - 1 = {n} then s.term else s.mid end,
      head := case when e.k - 1 < {n} then s.head + s.term else s.head end,
      tail := case when e.k - 1 >= {n} then s.tail + s.term else s.tail end))"""


def _t_tail_sql(t2: str, df: str, s: str) -> str:
    x = f"({df} / ({df} + {t2}))"
    scale = f"case when {df} % 2 = 1 then sqrt({t2} / ({df} + {t2})) * sqrt({x}) * (2 / pi()) else sqrt({t2} / ({df} + {t2})) end"
    angle = f"case when {df} % 2 = 1 then atan(sqrt({t2} / {df})) * (2 / pi()) else {D0} end"
    return f"(case when {t2} > 36 then {scale} * {s}.tail else greatest({D0}, 1 - ({angle} + {scale} * {s}.head)) end)"


def _f_tail_sql() -> str:
    """From columns t2 (= m F), m, df (doubles) and s (the series)."""
    x, y = "(df / (df + t2))", "(t2 / (df + t2))"
    start = f"case when m % 2 = 1 then {_t_tail_sql('t2', 'df', 's')} else pow({x}, df / 2) end"
    first = (f"case when m % 2 = 0 then pow({x}, df / 2) * {y} * (df / 2) "
             f"when df % 2 = 1 then sqrt({y}) * sqrt({x}) * (2 * floor(df / 2) + 1) * s.mid * (2 / pi()) "
             f"else sqrt({y}) * 2 * floor(df / 2) * s.mid end")
    b = "case when m % 2 = 1 then 0.5 else 1.0 end"
    out, term = start, first
    for k in range((_P - 2) // 2 + 1):           # at most (m - 1) / 2 closed terms
        out = f"({out}) + case when {k} < floor((m - 1) / 2) then {term} else {D0} end"
        term = f"({term}) * ({y} * ((df / 2 + ({b}) + {k}) / (({b}) + {k} + 1)))"
    return f"least({D1}, {out})"


FIT_SUMMARY = model_head(*_S_ARGS, extra=(*_quality_ctes(SESSIONS_TERMS), f"""fq as (
  select product_id, f, f * (rank - 1) as t2, cast(rank - 1 as double) as m, cast(n - rank as double) as df from (
    select *, ((tss - rss) / cast(rank - 1 as double)) / nullif(rss / cast(n - rank as double), 0) as f from q)),
fs as (select *, case when m >= 1 and df >= 1 and f > 0 then {_series_sql('t2', 'df')} end as s from fq),
fp as (select product_id, f, case when not (m >= 1 and df >= 1) then null when f <= 0 then 1 when f > 0 then {_f_tail_sql()} end as p from fs),
ct as (""" + "\nunion all\n".join(
    f"select 'sessions' as target, m.product_id, cast({i} as integer) as term_index, '{t}' as term, m.beta_{i} as estimate, "
    f"sqrt(q.rss / cast(m.n - m.rank as double) * m.inv_{i}) as se, "
    f"m.beta_{i} / nullif(sqrt(q.rss / cast(m.n - m.rank as double) * m.inv_{i}), 0) as t, m.n - m.rank as df_resid "
    f"from om m join q on m.product_id = q.product_id where m.status = 'ok'" for i, t in enumerate(_NAMES_S)) + f"""),
cs as (select *, t * t as t2, cast(df_resid as double) as df, case when t is not null then {_series_sql('(t * t)', 'cast(df_resid as double)')} end as s from ct)
""")) + f"""
select target, cs.product_id, term_index, term, {r6('estimate')} as estimate, {r6('se')} as std_error, {r6('t')} as t_value, df_resid,
  {r6('case when t is not null then ' + _t_tail_sql('t2', 'df', 's') + ' end')} as p_value,
  {r6('fp.f')} as f_statistic, {r6('fp.p')} as f_p_value
from cs left join fp on cs.product_id = fp.product_id"""


# ---- residuals: lag-1 products, and their squares fitted on the same terms
_AUX = tuple(c.replace("fr as", "fr2 as").replace("q as", "q2 as").replace("from fr ", "from fr2 ").replace("from scaled s join om m", "from squares s join am m")
             for c in _quality_ctes(SESSIONS_TERMS))
RESIDUAL_DIAGNOSTICS = model_head(*_S_ARGS, extra=(
    _OK_ROWS(SESSIONS_TERMS),
    "rs as materialized (select product_id, date, dep_var - fitted as e, " + ", ".join(SESSIONS_TERMS) + " from fr)",
    """dw as (select product_id, sum((e - before) * (e - before)) / nullif(sum(e * e), 0) as durbin_watson from (
  select *, lag(e) over (partition by product_id order by date) as before from rs) group by product_id)""",
    "squares as materialized (select product_id, date, e * e as dep_var, " + ", ".join(SESSIONS_TERMS) + " from rs)",
    *ols_ctes(SESSIONS_TERMS, "squares", "a"), *_AUX,
    """fq as (select product_id, n, 1 - rss / nullif(tss, 0) as r2, f, f * (rank - 1) as t2, cast(rank - 1 as double) as m,
  cast(n - rank as double) as df from (
    select *, ((tss - rss) / cast(rank - 1 as double)) / nullif(rss / cast(n - rank as double), 0) as f from q2))""",
    f"fs as (select *, case when m >= 1 and df >= 1 and f > 0 then {_series_sql('t2', 'df')} end as s from fq)")) + f"""
select 'sessions' as target, fs.product_id, n, {r6('durbin_watson')} as durbin_watson, {r6('n * r2')} as breusch_pagan, {r6('f')} as bp_f,
  {r6('case when not (m >= 1 and df >= 1) then null when f <= 0 then 1 when f > 0 then ' + _f_tail_sql() + ' end')} as bp_p_value
from fs left join dw on fs.product_id = dw.product_id"""

# ---- how fits come out: a Christmas flag (some products have no row on one), or all three weather flags
def _status_sql(extra: str, label: str) -> str:
    terms = SESSIONS_TERMS + (extra,)
    named = "raw_design as (select f.*, " + (f"case when f.date in ({_XMAS}) then {D1} else {D0} end as xmas" if extra == "xmas" else
                                              "d.average_weather_days") + (
        " from raw0 f join panel_drivers d on f.product_id = d.product_id and f.date = d.date)")
    design = design_ctes()
    design[-1] = design[-1].replace("raw_design as", "raw0 as")
    sds = " + ".join(f"case when stddev_samp({t}) = 0 then 1 else 0 end" for t in terms if t != "tv_adstock")
    p = len(terms) + 1
    return with_(PANEL, META, TRAIN, DRIVERS, *design, named, scaled_cte(terms, None), *ols_ctes(terms, "scaled", "o"),
                 f"cst as (select product_id, cast({sds} as bigint) as constant_terms from raw_design group by product_id)",
                 recursive=True) + f"""
select '{label}' as terms, 'sessions' as target, om.product_id, status, rank, n, constant_terms,
  {p} - rank - constant_terms as aliased_terms,
  case when {p} - rank - constant_terms > 0 then 'rank_deficient' when constant_terms > 0 then 'constant_term' else 'full_rank' end as note
from om join cst on om.product_id = cst.product_id"""


FIT_STATUS = f"select * from ({_status_sql('xmas', 'with_christmas')}) union all select * from ({_status_sql('average_weather_days', 'all_weather')})"

# ---- every candidate of the transform search as a group of its own
_SHARED = ("day_friday", "day_saturday", "day_sunday", "consumer_confidence_index",
           "better_than_average_weather_days", "worse_than_average_weather_days")
_SEARCH_TERMS = _SHARED + ("tv", "fx", "vis")


def _search_sql() -> str:
    zs = ", ".join(f"{z(c)} as {c}" for c in _SHARED + ("fx_mean", "fx_lag", "vis_1", "vis_2", "vis_4"))
    known = " and ".join(f"{c} is not null" for c in ("dep_var", "fx_mean", "fx_lag", "vis_1") + _SHARED)
    return with_(
        PANEL, META, TRAIN, DRIVERS, *adstock_ctes("panel_drivers", "tv_ad_reach", rates=DECAY),
        """s0 as (select product_id, date, cast(sessions as double) as dep_var, row_number() over w as rn,
  avg(exchange_rate) over (w rows between 9 preceding and current row) as m10, lag(exchange_rate) over w as fx_lag,
  consumer_confidence_index, online_visibility, better_than_average_weather_days, worse_than_average_weather_days
  from panel_drivers window w as (partition by product_id order by date))""",
        f"""s1 as (select *, case when rn >= 10 then m10 else max(case when rn = 10 then m10 end) over (partition by product_id) end as fx_mean,
  online_visibility as vis_1, pow(online_visibility, 2) as vis_2, pow(online_visibility, 4) as vis_4,
  case when dayofweek(date) = 5 then {D1} else {D0} end as day_friday, case when dayofweek(date) = 6 then {D1} else {D0} end as day_saturday,
  case when dayofweek(date) = 0 then {D1} else {D0} end as day_sunday from s0)""",
        f"s2 as (select product_id, date, dep_var, {zs} from s1)",
        f"s3 as materialized (select * from s2 where {known})",
        f"""cand as (select rate, f, p, rate || '/' || f || '/' || p as c from
  (values {', '.join(f'(cast({r!r} as double))' for r in DECAY)}) a(rate), (values ('mean'), ('lag')) b(f),
  (values ({D1}), (cast(2 as double)), (cast(4 as double))) d(p))""",
        f"""scaled as materialized (select s3.product_id || '#' || c as product_id, dep_var, {', '.join(_SHARED)}, ln(1 + a) as tv,
  case f when 'mean' then fx_mean else fx_lag end as fx, case p when 1 then vis_1 when 2 then vis_2 else vis_4 end as vis
  from s3 join ad_rows r on r.product_id = s3.product_id and r.date = s3.date join cand on cand.rate = r.rate)""",
        *ols_ctes(_SEARCH_TERMS, "scaled", "o"),
        f"""sf as (select m.product_id, any_value(m.n) as n, any_value(m.rank) as rank, any_value(status) as status,
  sum((dep_var - fitted) * (dep_var - fitted)) as rss, sum((dep_var - mean_y) * (dep_var - mean_y)) as tss
  from (select s.*, {_fitted(_SEARCH_TERMS)} as fitted from scaled s join om m on m.product_id = s.product_id) s
  join om m on m.product_id = s.product_id group by m.product_id)""",
        """sr as (select split_part(sf.product_id, '#', 1) as product_id, rate as adstock_rate, f as fx_transform, p as visibility_power,
  n, rank, case when status = 'ok' then sqrt(rss / n) end as rmse, case when status = 'ok' then 1 - rss / nullif(tss, 0) end as r_squared
  from sf join cand on cand.c = split_part(sf.product_id, '#', 2))""", recursive=True) + f"""
select product_id, adstock_rate, fx_transform, visibility_power, n, rank, {r6('rmse')} as rmse, {r6('r_squared')} as r_squared,
  row_number() over (partition by product_id order by round(rmse, 6) asc nulls last, adstock_rate, fx_transform, visibility_power) as fit_rank
from sr"""


TRANSFORM_SEARCH = _search_sql()

# ---- contributions
def _group_exprs(terms) -> list[str]:
    names = ("intercept",) + tuple(terms)
    out = []
    for g in _GROUPS:
        parts = [f"coalesce(m.beta_{i}, {D0}) * {D1 if i == 0 else 's.' + t}"
                 for i, t in enumerate(names) if _TERM_GROUP[t] == g]
        out.append(f"({' + '.join(parts) if parts else D0}) as {g}")
    return out


def _contrib_ctes(terms, smooth: bool = True, rebase: bool = True) -> tuple[str, ...]:
    cc = " and ".join(f"s.{c} is not null" for c in ("dep_var",) + tuple(terms))
    ctes = [f"cw as (select s.product_id, s.date, {', '.join(_group_exprs(terms))} "
            f"from scaled s join om m on s.product_id = m.product_id where m.status = 'ok' and {cc})"]
    src = "cw"
    if smooth:
        others = [g for g in _GROUPS if g != "Base_Sales"]
        inner = ", ".join(
            f"avg({g}) over (partition by product_id order by date rows between 3 preceding and 3 following) as m_{g}"
            for g in others)
        ctes.append(f"""cs0 as (select *, row_number() over (partition by product_id order by date) as rn,
  count(*) over (partition by product_id) as cnt, {inner} from cw)""")
        sm = ", ".join(f"""case when cnt < 7 then null
  when rn < 4 then max(case when rn = 4 then m_{g} end) over (partition by product_id)
  when rn > cnt - 3 then max(case when rn = cnt - 3 then m_{g} end) over (partition by product_id)
  else m_{g} end as {g}""" for g in others)
        ctes.append(f"cs as (select product_id, date, Base_Sales, {sm} from cs0)")
        src = "cs"
    if rebase:
        add = f"(((({D0}) + min({_REBASED[0]}) over w) + min({_REBASED[1]}) over w) + min({_REBASED[2]}) over w)"
        cols = [f"Base_Sales + {add} as Base_Sales"] + [
            f"{g} - min({g}) over w as {g}" if g in _REBASED else g for g in _GROUPS if g != "Base_Sales"]
        ctes.append(f"cr as (select product_id, date, {', '.join(cols)} from {src} window w as (partition by product_id))")
        src = "cr"
    ctes.append(f"cfin as (select * from {src})")
    return tuple(ctes)


def _order_sql(col: str = "driver_group") -> str:
    whens = " ".join(f"when '{g}' then {i + 1}" for i, g in enumerate(_ORDER))
    return f"cast(case {col} {whens} end as bigint)"


def _long(src: str, ids: str, value=r6) -> str:
    return "\nunion all\n".join(
        f"select {ids}, '{g}' as driver_group, {value(g)} as value, {_order_sql(repr(g))} as driver_order from {src}"
        for g in _GROUPS)


def _contrib_head(args, extra=()):
    target, terms, fit_from = args
    return model_head(target, terms, fit_from, extra=_contrib_ctes(terms) + tuple(extra))


# sums of some 10^5 groups: one value in the last of 8 digits differs with the order of summation in most runs
def _r_long(expr: str) -> str:
    return r6(expr, 6)


CONTRIBUTION_DAILY = _contrib_head(_S_ARGS) + _long("cfin", "product_id, date")
CONTRIBUTION_DAILY_BOOKINGS = _contrib_head(_B_ARGS) + _long("cfin", "product_id, date")
_SUMS = ", ".join(f"sum({g}) as {g}" for g in _GROUPS)
CONTRIBUTION_ANNUAL = _contrib_head(_S_ARGS, (
    f"ya as (select product_id, cast(year(date) as bigint) as year, {_SUMS} from cfin group by 1, 2)",)) + \
    _long("ya", "product_id, year")
_WEEK = "cast(date_trunc('year', date) as date) + cast(floor((dayofyear(date) - 1) / 7) * 7 as integer)"
CONTRIBUTION_WEEKLY = _contrib_head(_S_ARGS, (
    f"wk as (select product_id, {_WEEK} as week_commencing, {_SUMS} from cfin group by 1, 2)",)) + \
    _long("wk", "product_id, week_commencing", value=_r_long)
_BYP = f"bp as (select product_id, {_SUMS} from cfin group by product_id)"
CONTRIBUTION_BY_PRODUCT = _contrib_head(_S_ARGS, (_BYP,)) + _long("bp", "product_id")
CONTRIBUTION_BY_PRODUCT_BOOKINGS = _contrib_head(_B_ARGS, (_BYP,)) + _long("bp", "product_id")


CONTRIBUTION_ROLLUPS = _contrib_head(_S_ARGS, (
    f"ya as (select product_id, cast(year(date) as bigint) as year, {_SUMS} from cfin group by 1, 2)",
    f"wk as (select product_id, {_WEEK} as week_commencing, {_SUMS} from cfin group by 1, 2)", _BYP)) + \
    _long("ya", "product_id, 'year' as level, year, cast(null as date) as week_commencing", value=_r_long) + "\nunion all\n" + \
    _long("wk", "product_id, 'week' as level, cast(null as bigint) as year, week_commencing", value=_r_long) + "\nunion all\n" + \
    _long("bp", "product_id, 'product' as level, cast(null as bigint) as year, cast(null as date) as week_commencing", value=_r_long)


def _share_sql(args) -> str:
    return _contrib_head(args, (_BYP, "lg as (" + _long("bp", "product_id", value=lambda g: g) + ")")) + f"""
select product_id, driver_group, {r6('value')} as value, driver_order,
       {r6('value / nullif(sum(abs(value)) over (partition by product_id, sign(value)), 0)')} as share
from lg"""


CONTRIBUTION_SHARE = _share_sql(_S_ARGS)
CONTRIBUTION_SHARE_BOOKINGS = _share_sql(_B_ARGS)

_RAW_TERMS = "\nunion all\n".join(
    f"select s.product_id, s.date, '{t}' as var_name, coalesce(m.beta_{i}, {D0}) * {D1 if i == 0 else 's.' + t} as value "
    f"from scaled s join om m on s.product_id = m.product_id where m.status = 'ok' and "
    + " and ".join(f"s.{c} is not null" for c in ("dep_var",) + SESSIONS_TERMS)
    for i, t in enumerate(_NAMES_S))
_DICT = ", ".join(f"('{t}', '{g}')" for t, g in _TERM_GROUP.items())
CONTRIBUTION_TERMS_GROUPED = model_head(*_S_ARGS, extra=(f"tl as ({_RAW_TERMS})",)) + f"""
select tl.product_id, tl.date, d.grouping as driver_group, {r6('sum(tl.value)')} as value
from tl left join (values {_DICT}) d(var_name, grouping) on tl.var_name = d.var_name
group by 1, 2, 3"""

# ---- segment features: driver ratios + product statistics, z-scored across products
_RATIOS = [g for g in _GROUPS if g != "Base_Sales"]
_STATS = ("n_total_sessions", "n_total_bookings", "sd_total_sessions", "sd_total_bookings", "av_conv_rate", "uplift")
_FEATURES = tuple(_RATIOS) + _STATS
_SEG = (
    _BYP,
    f"""st as (select product_id, cast(sum(sessions) as double) as n_total_sessions,
  cast(sum(bookings) as double) as n_total_bookings, stddev_samp(sessions) as sd_total_sessions,
  stddev_samp(bookings) as sd_total_bookings,
  avg(cast(bookings as double) / nullif(cast(sessions as double), 0)) as av_conv_rate,
  {_UPLIFT} as uplift from panel_train group by product_id)""",
    "seg as materialized (select bp.product_id, " + ", ".join(f"bp.{g} / nullif(bp.Base_Sales, 0) as {g}" for g in _RATIOS)
    + ", " + ", ".join(f"st.{c}" for c in _STATS) + " from bp left join st on bp.product_id = st.product_id)",
    "segok as (select * from seg where " + " and ".join(f"{c} is not null" for c in _FEATURES) + ")",
    "segz as materialized (select product_id, " + ", ".join(f"{z(c, '')} as {c}" for c in _FEATURES) + " from segok)",
)
SEGMENT_FEATURES = _contrib_head(_S_ARGS, _SEG) + "select seg.product_id, " + ", ".join(
    f"{r6('segz.' + c)} as {c}" for c in _FEATURES) + """,
  case when segz.product_id is null then 'null_feature' end as reason
from seg left join segz on seg.product_id = segz.product_id"""

# ---- k-means: whole-number Lloyd steps as a recursive state, one row per k
_KS, _K, _STEPS = 15, 3, 200


def _dist(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda q: cast(q[1] - q[2] as double) * cast(q[1] - q[2] as double)))"


def _start_ctes() -> list[str]:
    """The farthest point from the origin, then from the centres so far (ties: smaller product_id)."""
    zero = "[" + ", ".join(["0"] * len(_FEATURES)) + "]"
    out = [f"near0 as (select product_id, x, {_dist('x', zero)} as near from pts)"]
    for i in range(1, _KS + 1):
        out.append(f"c{i} as (select x from near{i - 1} {'where near > 0' if i > 1 else ''} order by near desc, product_id limit 1)")
        here = _dist("n.x", f"c{i}.x")
        out.append(f"near{i} as (select n.product_id, n.x, {here if i == 1 else f'least(n.near, {here})'} as near from near{i - 1} n, c{i})")
    arms = " union all ".join(f"select {i} as i, x from c{i}" for i in range(1, _KS + 1))
    out.append(f"centre_list as materialized (select list(x order by i) as cs from ({arms}))")
    return out


_KMEANS = _SEG + (
    "pts as materialized (select product_id, [" + ", ".join(
        f"cast(round_even({c} * 1000000, 0) as bigint)" for c in _FEATURES) + "] as x from segz)",
    *_start_ctes(),
    "starts as (select cast(k as bigint) as k, cs[1:k] as centres from centre_list, range(1, " + str(_KS + 1) + ") r(k) where len(cs) >= k)",
    f"""lloyd as (
  select k, 0 as step, centres, false as settled, cast(0 as hugeint) as cost from starts
  union all
  select k, step + 1, moved, moved = centres, cost from (
    select k, any_value(step) as step, any_value(centres) as centres, cast(sum(cost) as hugeint) as cost,
      list_transform(any_value(centres), lambda c, i: coalesce(
        list_extract(list_filter(list(struct_pack(j := cluster, m := mean)), lambda w: w.j = i), 1).m, c)) as moved
    from (
      select k, cluster, any_value(step) as step, any_value(centres) as centres, cast(sum(cast(d as hugeint)) as hugeint) as cost,
        [{', '.join(f'cast((2 * sum(x[{i}]) + sign(sum(x[{i}])) * count(*)) // (2 * count(*)) as bigint)' for i in range(1, len(_FEATURES) + 1))}] as mean
      from (select k, step, centres, x, list_min(dd) as d, list_position(dd, list_min(dd)) as cluster from (
        select s.k, s.step, s.centres, p.x, list_transform(s.centres, lambda c: {_dist('p.x', 'c')}) as dd
        from lloyd s, pts p where not s.settled and s.step < {_STEPS}))
      group by k, cluster)
    group by k))""",
    f"fits as materialized (select * from lloyd where settled or step = {_STEPS})",
    "fit as (select centres, settled, k from fits where k = (select least(" + str(_K) + ", len(cs)) from centre_list))",
    f"""pred as (select product_id, list_position(dd, list_min(dd)) as cluster from (
  select p.product_id, list_transform(fit.centres, lambda c: {_dist('p.x', 'c')}) as dd from pts p, fit))""",
    """named as (select cluster, 'type_' || row_number() over (order by count(*) desc, min(product_id)) as product_type
  from pred group by cluster)""",
    "groups as (select product_id, product_type from pred join named on pred.cluster = named.cluster)",
)

ELBOW = _contrib_head(_S_ARGS, _KMEANS) + f"""
select cast(r.k as bigint) as k, {r6('cast(cost as double) / 1e12')} as tot_withinss,
  case when fits.k is null then 'too_few_products' when settled then 'ok' else 'not_converged' end as status
from range(1, {_KS + 1}) r(k) left join fits on fits.k = r.k"""

PRODUCT_GROUPINGS = _contrib_head(_S_ARGS, _KMEANS) + f"""
select seg.product_id, product_type, case when groups.product_id is null then 'null_feature'
  when (select k from fit) < {_K} then 'fewer_clusters' when (select settled from fit) then 'ok' else 'not_converged' end as status
from seg left join groups on seg.product_id = groups.product_id"""

CLUSTER_PROFILE = _contrib_head(_S_ARGS, _KMEANS) + "select product_type, count(*) as n_products, " + ", ".join(
    f"{r6(f'avg(seg.{c})')} as {c}" for c in _FEATURES) + """
from seg join groups on seg.product_id = groups.product_id group by product_type"""

ANSWER_SHEET = _contrib_head(_S_ARGS, _KMEANS) + """
select p.product_id, product_type from (select distinct product_id from product_series) p
left join groups on p.product_id = groups.product_id"""


# ---- forecasts
def _stats_cte(terms, pre: str) -> str:
    cols = ", ".join(f"avg({t}) as {pre}mean_{t}, stddev_samp({t}) as {pre}sd_{t}" for t in terms if t != "tv_adstock")
    return f"{pre}st as (select product_id, {cols} from raw_design group by product_id)"


def _pred(terms, m: str, st: str | None, h: str) -> str:
    names = ("intercept",) + tuple(terms)
    out = f"coalesce({m}.beta_0, {D0})"
    for i, t in enumerate(names[1:], start=1):
        x = f"{h}.{t}"
        if st is not None and t != "tv_adstock":
            x = f"coalesce(({x} - {st}mean_{t}) / nullif({st}sd_{t}, 0), {D0})"
        out = f"({out} + coalesce({m}.beta_{i}, {D0}) * {x})"
    return f"case when {m}.beta_0 is not null then {out} end"


def _forecast_sql(scale: str) -> str:
    hterms = _H_TERMS
    if scale == "train":
        hsel = "select date, " + ", ".join(hterms) + " from hraw where date >= date '2000-01-01'"
    else:
        hsel = ("select * from (select date, " + ", ".join(f"{z(t, '')} as {t}" for t in hterms)
                + " from hraw) where date >= date '2000-01-01'")
    ctes = [PANEL, META, TRAIN, DRIVERS, *design_ctes(),
            scaled_cte(SESSIONS_TERMS, None, name="ss", target="sessions"),
            *ols_ctes(SESSIONS_TERMS, "ss", "os"),
            scaled_cte(BOOKINGS_TERMS, "1998-01-01", name="sb", target="bookings"),
            *ols_ctes(BOOKINGS_TERMS, "sb", "ob"),
            _stats_cte(SESSIONS_TERMS, "s_"), _stats_cte(BOOKINGS_TERMS, "b_"),
            *_meta_design(), f"hz as ({hsel})",
            f"""fw as (select ms.product_id, h.date,
  {_pred(SESSIONS_TERMS, 'ms', 'sst.s_' if scale == 'train' else None, 'h')} as sessions,
  {_pred(BOOKINGS_TERMS, 'mb', 'bst.b_' if scale == 'train' else None, 'h')} as bookings
  from (select * from osm where status = 'ok') ms
  left join (select * from obm where status = 'ok') mb on ms.product_id = mb.product_id
  left join s_st sst on ms.product_id = sst.product_id
  left join b_st bst on ms.product_id = bst.product_id
  cross join hz h)"""]
    return with_(*ctes, recursive=True)


FORECAST_LONG = _forecast_sql("train") + f"""
select product_id, date, 'sessions' as target, {r6('sessions')} as prediction from fw
union all select product_id, date, 'bookings' as target, {r6('bookings')} as prediction from fw"""

FORECAST_HORIZON_SCALED = _forecast_sql("horizon") + f"""
select product_id, date, {r6('sessions')} as sessions, {r6('bookings')} as bookings from fw"""

ACTUAL_PLUS_FORECAST = _forecast_sql("train") + f"""
select product_id, date, cast(sessions as double) as sessions, cast(bookings as double) as bookings, 'actual' as kind
from panel_train
union all
select product_id, date, {r6('sessions')} as sessions, {r6('bookings')} as bookings, 'forecast' as kind from fw"""


# ---- the Total series alone, missing scaled terms interpolated by row position before the fit
def _interp_cte(terms, src: str, name: str) -> list[str]:
    scaled_t = [t for t in terms if t != "tv_adstock"]
    w_back = "partition by product_id order by rn rows between unbounded preceding and current row"
    w_fwd = "partition by product_id order by rn rows between current row and unbounded following"
    cols = []
    for t in scaled_t:
        cols += [f"last_value({t} ignore nulls) over ({w_back}) as pv_{t}",
                 f"last_value(case when {t} is not null then rn end ignore nulls) over ({w_back}) as pr_{t}",
                 f"first_value({t} ignore nulls) over ({w_fwd}) as nv_{t}",
                 f"first_value(case when {t} is not null then rn end ignore nulls) over ({w_fwd}) as nr_{t}"]
    fill = ", ".join(
        f"case when {t} is not null then {t} when pv_{t} is null then nv_{t} when nv_{t} is null then pv_{t} "
        f"else pv_{t} + (nv_{t} - pv_{t}) * (cast(rn - pr_{t} as double) / cast(nr_{t} - pr_{t} as double)) end as {t}"
        for t in scaled_t)
    return [f"{name}0 as (select *, row_number() over (partition by product_id order by date) as rn from {src})",
            f"{name}1 as (select *, {', '.join(cols)} from {name}0)",
            f"{name} as (select product_id, date, dep_var, tv_adstock, {fill} from {name}1)"]


def _ols_total_sql(args) -> str:
    target, terms, fit_from = args
    return with_(PANEL, META, TRAIN, TRAIN_TOTAL, drivers("panel_train_total"),
                 "tot_drivers as (select * from panel_drivers where product_id = 'Total')",
                 *design_ctes(src="tot_drivers"), scaled_cte(terms, fit_from, target=target),
                 *_interp_cte(terms, "scaled", "filled"), *ols_ctes(terms, "filled", "o"),
                 recursive=True) + "\nunion all\n".join(
        f"select '{target}' as target, product_id, status, rank, n, cast({i} as integer) as term_index, "
        f"'{t}' as term, {r6(f'beta_{i}')} as estimate from om" for i, t in enumerate(("intercept",) + terms))


OLS_TOTAL = _ols_total_sql(_S_ARGS)
OLS_TOTAL_BOOKINGS = _ols_total_sql(_B_ARGS)

FORECAST_PREVIEW = _forecast_sql("train") + f"""
select product_id, date, {r6('sessions')} as sessions, {r6('bookings')} as bookings from fw
order by product_id, date limit 6"""


def _total_head(args, extra=()) -> str:
    target, terms, fit_from = args
    return with_(PANEL, META, TRAIN, TRAIN_TOTAL, drivers("panel_train_total"),
                 "tot_drivers as (select * from panel_drivers where product_id = 'Total')",
                 *design_ctes(src="tot_drivers"), scaled_cte(terms, fit_from, name="zdesign", target=target),
                 *_interp_cte(terms, "zdesign", "scaled"), *ols_ctes(terms, "scaled", "o"),
                 *_contrib_ctes(terms), *extra, recursive=True)


_BY_YEAR = f"ya as (select product_id, cast(year(date) as bigint) as year, {_SUMS} from cfin group by 1, 2)"
CONTRIBUTION_TOTAL_DAILY = _total_head(_S_ARGS) + _long("cfin", "product_id, date")
CONTRIBUTION_TOTAL_ANNUAL = _total_head(_S_ARGS, (_BY_YEAR,)) + _long("ya", "product_id, year")
CONTRIBUTION_TOTAL_DAILY_BOOKINGS = _total_head(_B_ARGS) + _long("cfin", "product_id, date")
CONTRIBUTION_TOTAL_ANNUAL_BOOKINGS = _total_head(_B_ARGS, (_BY_YEAR,)) + _long("ya", "product_id, year")

# ---- one series alone: the one with the most sessions
_LEAD = ("(select product_id from (select cast(l_suppkey as varchar) as product_id, sum(l_quantity) as total from lineitem "
         "where cast(l_shipdate as date) <= date '1999-12-31' group by 1) order by total desc, product_id limit 1)")
ONE_PRODUCT_VIEW = f"select * from ({ACTUAL_PLUS_FORECAST}) where product_id = {_LEAD}"
ONE_PRODUCT_OVERLAY = f"select * from ({DRIVER_OVERLAY}) where product_id = {_LEAD}"
