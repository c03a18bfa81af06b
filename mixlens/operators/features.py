"""Model specs and the feature builder (M1 sessions, M2 bookings, M18 horizon, M21).

``build_design`` turns the panel-with-drivers into one row per (product, date)
with the target and the raw terms of a ``ModelSpec``; ``scale_design`` z-scores
the terms per product over the spec's scale range.  All windows share
``partitionBy(product_id).orderBy(date)``: one exchange, one sort.

Backward-looking windows (adstock, right-aligned mean, lag) make the cut at the
END of the training range legal before the windows run, so that filter is
applied first and reaches the scan; the cut at the START stays after them so
the history warms up the windows.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixlens.functions.scalar import date_in, weekday_flag
from mixlens.operators import longseries as L
from mixlens.operators import series as S

KEY, DATE = "product_id", "date"


@dataclass(frozen=True)
class ModelSpec:
    """What one family of per-product linear models is fitted on.

    ``terms`` is the ordered predictor list (the intercept is implicit and
    first).  Dates are inclusive.  ``scale_from`` is where z-score statistics
    start; ``fit_from`` where fitting rows start (bookings: scale on the full
    range, then fit on the later part)."""
    target: str
    terms: tuple[str, ...]
    train_to: _dt.date
    scale_from: _dt.date | None = None
    fit_from: _dt.date | None = None
    adstock_rate: float = 0.8
    fx_window: int = 10
    visibility_power: float = 2.0
    weekend_days: tuple[str, str, str] = ("Friday", "Saturday", "Sunday")
    unscaled: tuple[str, ...] = ("tv_adstock",)
    impute: bool = False   # interpolate missing scaled terms by row position before fitting (W8)
    tv_on_null: str = "zero"   # 'propagate': after the first unknown TV value the adstock stays unknown (W1)

    @property
    def all_terms(self) -> tuple[str, ...]:
        return ("intercept",) + self.terms

    def scaled_terms(self) -> tuple[str, ...]:
        return tuple(t for t in self.terms if t not in self.unscaled)


# --- fixed values: the model set-ups (stand-in dates of the test tables) --------
TRAIN_TO = _dt.date(1999, 12, 31)          # training is date < 2000-01-01
HORIZON_FROM = _dt.date(2000, 1, 1)        # forecast horizon starts here
BOOKINGS_FIT_FROM = _dt.date(1998, 1, 1)   # bookings are fitted on the later years only
UPLIFT_YEARS = (1999, 1997)                # uplift = sessions(1999) / sessions(1997)
CHRISTMAS = ("1995-12-25", "1996-12-25", "1997-12-25", "1998-12-25", "1999-12-25")
ADSTOCK_RATE = 0.8
FX_WINDOW = 10
SMOOTH_WINDOW = 7
DECAY_RATES = (0.1, 0.5, 0.8, 0.9)

SESSIONS_TERMS = (
    "day_friday", "day_saturday", "day_sunday", "tv_adstock", "consumer_confidence_index",
    "exchange_rate_moving_av", "online_visibility",
    "better_than_average_weather_days", "worse_than_average_weather_days",
)
BOOKINGS_TERMS = (
    "day_friday", "day_saturday", "day_sunday", "tv_adstock", "consumer_confidence_index",
    "exchange_rate_moving_av", "online_visibility_exp",
    "better_than_average_weather_days", "worse_than_average_weather_days",
)
# --------------------------------------------------------------------------------

SESSIONS_SPEC = ModelSpec(target="sessions", terms=SESSIONS_TERMS, train_to=TRAIN_TO)
BOOKINGS_SPEC = ModelSpec(target="bookings", terms=BOOKINGS_TERMS, train_to=TRAIN_TO,
                          fit_from=BOOKINGS_FIT_FROM)


def compat_spec(spec: ModelSpec) -> ModelSpec:
    """The reference's literal set-up: its 'Friday' flag is set on Wednesdays."""
    return replace(spec, weekend_days=("Wednesday", "Saturday", "Sunday"))


# the single 'Total' models fill missing scaled terms by interpolation first
TOTAL_SPEC = replace(SESSIONS_SPEC, impute=True)
TOTAL_BOOKINGS_SPEC = replace(BOOKINGS_SPEC, impute=True)


def strict_spec(spec: ModelSpec) -> ModelSpec:
    """The plain recursion: an unknown TV value makes every later adstock of the series unknown."""
    return replace(spec, tv_on_null="propagate")


def _derive(df: DataFrame, spec: ModelSpec, by) -> DataFrame:
    """Window-derived and row-derived raw terms (shared by fit and horizon)."""
    df = S.adstock(df, "tv_ad_reach", spec.adstock_rate, by=by, order=DATE, out="tv_adstock_raw",
                   on_null=spec.tv_on_null)
    df = S.rolling_mean_right(df, "exchange_rate", spec.fx_window, by=by, order=DATE,
                              out="exchange_rate_moving_av")
    return _derive_rows(df, spec)


def _derive_rows(df: DataFrame, spec: ModelSpec) -> DataFrame:
    fri, sat, sun = spec.weekend_days
    return df.withColumns({
        "day_friday": weekday_flag(DATE, fri),
        "day_saturday": weekday_flag(DATE, sat),
        "day_sunday": weekday_flag(DATE, sun),
        "tv_adstock": F.log1p(F.col("tv_adstock_raw")),
        "online_visibility_exp": F.pow(F.col("online_visibility"), F.lit(spec.visibility_power)),
        "xmas": date_in(DATE, CHRISTMAS),
    })


def build_design(panel_drivers: DataFrame, spec: ModelSpec) -> DataFrame:
    """Raw design rows (product_id, date, dep_var, *terms) over the scale range."""
    df = panel_drivers.filter(F.col(DATE) <= F.lit(spec.train_to))
    df = _derive(df, spec, KEY)
    if spec.scale_from is not None:
        df = df.filter(F.col(DATE) >= F.lit(spec.scale_from))
    return df.select(KEY, DATE, F.col(spec.target).cast("double").alias("dep_var"), *spec.terms)


def scale_design(design: DataFrame, spec: ModelSpec, keep_stats: bool = False) -> DataFrame:
    """Z-score the scaled terms per product over the rows present (the scale
    range), then cut to the fit range.  With ``keep_stats`` the per-product mean
    and SD of each term stay as ``mean__t`` / ``sd__t`` columns (the fit keeps
    them in the model row, so a horizon can be scaled the way the fit was).
    A NULL term stays NULL; a constant term scales to 0.0 (aliased in the fit)."""
    w = Window.partitionBy(KEY)
    cols = {}
    for t in spec.scaled_terms():
        x = F.col(t).cast("double")
        cols[f"mean__{t}"] = F.avg(x).over(w)
        cols[f"sd__{t}"] = F.stddev_samp(x).over(w)
    out = design.withColumns(cols)
    out = out.withColumns({
        t: F.when(F.col(t).isNotNull(), F.coalesce(
            F.try_divide(F.col(t) - F.col(f"mean__{t}"), F.col(f"sd__{t}")), F.lit(0.0)))
        for t in spec.scaled_terms()})
    if not keep_stats:
        out = out.drop(*cols)
    if spec.fit_from is not None:
        out = out.filter(F.col(DATE) >= F.lit(spec.fit_from))
    if spec.impute:
        for t in spec.scaled_terms():
            out = S.interpolate(out, t, by=KEY, order=DATE)
    return out


def features(panel_drivers: DataFrame, spec: ModelSpec) -> DataFrame:
    """M1 / M2: the fitted design, scaled."""
    return scale_design(build_design(panel_drivers, spec), spec)


def horizon_features(meta_onehot: DataFrame, spec: ModelSpec, horizon_from: _dt.date = HORIZON_FROM,
                     scale: str = "horizon", terms: tuple[str, ...] | None = None) -> DataFrame:
    """M18 features on the driver series alone (one row per date).

    scale='horizon' z-scores every term, TV included, over the whole driver
    series (the reference's scoring set-up); scale='none' leaves raw terms for
    scoring with each product's training statistics.  The driver series has no
    key, so its windows run as one ordered partition: one row per calendar day.
    """
    terms = terms or spec.terms
    df = _derive(meta_onehot, spec, None)
    df = df.select(DATE, *terms)
    if scale == "horizon":
        df = S.zscore(df, list(terms), by=None)
    return df.filter(F.col(DATE) >= F.lit(horizon_from)) if horizon_from else df


def horizon_features_blocks(meta_onehot: DataFrame, spec: ModelSpec, horizon_from: _dt.date = HORIZON_FROM,
                            terms: tuple[str, ...] | None = None, chunk: int = L.CHUNK) -> DataFrame:
    """M18 with scale='horizon' for a driver series larger than a task (sub-daily
    rows): the same features by blocks and a scan over blocks."""
    if spec.tv_on_null != "zero":
        raise ValueError("horizon_features_blocks: tv_on_null='zero' only")
    terms = terms or spec.terms
    df = L.lay_out(meta_onehot, DATE, chunk)
    df = L.adstock(df, "tv_ad_reach", spec.adstock_rate, out="tv_adstock_raw", chunk=chunk)
    df = _derive_rows(L.rolling_mean_right(df, "exchange_rate", spec.fx_window, out="exchange_rate_moving_av", chunk=chunk), spec)
    df = L.zscore(df.select(DATE, *terms), terms, suffix="")
    return df.filter(F.col(DATE) >= F.lit(horizon_from)) if horizon_from else df


def driver_overlay(design: DataFrame, variable: str, dep: str = "dep_var") -> DataFrame:
    """M21 the target and one driver z-scored side by side, per product."""
    out = S.zscore(design.select(KEY, DATE, dep, variable), [dep, variable], by=KEY, suffix="_z")
    return out.select(KEY, DATE, F.col(f"{dep}_z").alias("dep_var_z"), F.col(f"{variable}_z").alias("variable_z"))
