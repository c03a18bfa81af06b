"""The whole analysis as one batch job: fit both targets once, then write every
output the analysis produces, each from the stored models.

    python -m mixlens.plans.report --data /root/testdata/sf0.01 --out /shared/run-1
    python -m mixlens.plans.report --panel panel.csv --meta drivers.csv --groupings groups.csv --out /shared/run-1 \\
        --train-to 2017-12-31 --bookings-from 2016-01-01 --horizon-from 2018-01-01 --uplift-years 2017 2015

Outputs under ``--out``: ``models/`` (parquet, partitioned by target),
``contributions_daily/`` and ``contributions_by_product/`` (parquet, both
targets), ``product_groupings/`` (CSV with header), ``cluster_profile/``,
``elbow/``, ``predictions/`` (parquet).  The registry in ``queries.py`` builds
each result independently; this job shares the expensive steps between them.
"""

from __future__ import annotations

import argparse
import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlens.operators import contribution as C
from mixlens.operators import forecast as FC
from mixlens.operators import panel as P
from mixlens.operators import regression as R
from mixlens.operators import segment as SG
from mixlens.operators.features import (
    BOOKINGS_FIT_FROM, BOOKINGS_SPEC, DATE, HORIZON_FROM, SESSIONS_SPEC, TRAIN_TO, UPLIFT_YEARS)
from mixlens.session import cut_lineage
from mixlens.sources import io as IO
from mixlens.sources.tables import DRIVER_GROUPS, meta_series, product_series


@dataclass(frozen=True)
class Inputs:
    """The panel and the driver series of a report, and its dates and dictionary."""
    panel: DataFrame
    drivers: DataFrame
    train_to: dt.date = TRAIN_TO
    bookings_from: dt.date = BOOKINGS_FIT_FROM
    horizon_from: dt.date = HORIZON_FROM
    uplift_years: tuple[int, int] = UPLIFT_YEARS
    term_groups: dict[str, str] | None = None


def from_tables(spark: SparkSession, data_dir: str) -> Inputs:
    return Inputs(product_series(spark, data_dir), meta_series(spark, data_dir))


def from_csv(spark: SparkSession, panel: str, meta: str, out: str, groupings: str | None = None, **dates) -> Inputs:
    """Inputs from CSV files; what was rejected is written to ``out``/rejects."""
    found = {"panel": IO.check_panel_csv(spark, panel), "meta": IO.check_meta_csv(spark, meta)}
    if groupings:
        found["groupings"] = IO.check_groupings_csv(spark, groupings)
    for name, checked in found.items():
        checked.rejects.write.mode("overwrite").parquet(f"{out.rstrip('/')}/rejects/input={name}")
    groups = None
    if groupings:
        # one row per term name: as short as the list of terms
        groups = {r["var_name"]: r["grouping"] for r in found["groupings"].rows.limit(10_000).collect()}
        lacking = [t for spec in (SESSIONS_SPEC, BOOKINGS_SPEC) for t in spec.all_terms if t not in groups]
        unknown = sorted({groups[t] for spec in (SESSIONS_SPEC, BOOKINGS_SPEC) for t in spec.all_terms if t in groups} - set(DRIVER_GROUPS))
        if lacking or unknown:
            raise ValueError(f"{groupings}: terms without a group {lacking}, groups that are not drivers {unknown}")
    return Inputs(found["panel"].rows, found["meta"].rows, term_groups=groups, **dates)


def build_report(spark: SparkSession, inputs: Inputs | str, out_dir: str, k: int = 3) -> dict[str, str]:
    out = out_dir.rstrip("/")
    if isinstance(inputs, str):
        inputs = from_tables(spark, inputs)
    drivers = cut_lineage(inputs.drivers)
    train = inputs.panel.filter(F.col(DATE) <= F.lit(inputs.train_to))
    pdr = cut_lineage(P.weather_onehot(P.join_drivers(train, drivers, materialise=False)))
    specs = (replace(SESSIONS_SPEC, train_to=inputs.train_to),
             replace(BOOKINGS_SPEC, train_to=inputs.train_to, fit_from=inputs.bookings_from))
    fits = {spec.target: (spec, *R.fit(pdr, spec)) for spec in specs}
    models = fits["sessions"][1].unionByName(fits["bookings"][1])
    IO.write_models(models, f"{out}/models")

    daily = None
    by_product = {}
    for target, (spec, m, scaled) in fits.items():
        d = C.contribution_daily(scaled, m, spec, term_groups=inputs.term_groups).withColumn("target", F.lit(target))
        daily = d if daily is None else daily.unionByName(d)
        by_product[target] = cut_lineage(C.contribution_by_product_wide(scaled, m, spec, term_groups=inputs.term_groups))
    daily.write.mode("overwrite").partitionBy("target").parquet(f"{out}/contributions_daily")
    long = None
    for target, wide in by_product.items():
        lt = C.to_long(wide, ["product_id"]).withColumn("target", F.lit(target))
        long = lt if long is None else long.unionByName(lt)
    long.write.mode("overwrite").parquet(f"{out}/contributions_by_product")

    table = cut_lineage(SG.segment_table(by_product["sessions"], SG.product_stats(train, inputs.uplift_years)))
    scaled_features = SG.scale_features(table).persist()
    SG.elbow(scaled_features).write.mode("overwrite").parquet(f"{out}/elbow")
    groups = cut_lineage(SG.cluster(scaled_features, k=k))
    scaled_features.unpersist()
    IO.write_segments_csv(SG.with_unclustered(table, groups), f"{out}/product_groupings")
    SG.cluster_profile(table, groups).write.mode("overwrite").parquet(f"{out}/cluster_profile")

    wide = FC.forecast({t: (fits[t][1], fits[t][0]) for t in ("sessions", "bookings")}, drivers, horizon_from=inputs.horizon_from)
    wide.write.mode("overwrite").parquet(f"{out}/predictions")
    return {name: f"{out}/{name}" for name in ("models", "contributions_daily", "contributions_by_product",
                                               "elbow", "product_groupings", "cluster_profile", "predictions")}


def main(argv=None):
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--data", help="folder holding lineitem.parquet and orders.parquet")
    ap.add_argument("--panel", help="panel CSV (file, folder or glob): product_id, date, sessions, bookings")
    ap.add_argument("--meta", help="driver series CSV with day/month/year dates")
    ap.add_argument("--groupings", help="term -> driver group CSV")
    ap.add_argument("--train-to", type=dt.date.fromisoformat, default=TRAIN_TO)
    ap.add_argument("--bookings-from", type=dt.date.fromisoformat, default=BOOKINGS_FIT_FROM)
    ap.add_argument("--horizon-from", type=dt.date.fromisoformat, default=HORIZON_FROM)
    ap.add_argument("--uplift-years", type=int, nargs=2, default=UPLIFT_YEARS, metavar=("YEAR", "OVER"))
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    ap.add_argument("--k", type=int, default=3)
    args = ap.parse_args(argv)
    if bool(args.data) == bool(args.panel and args.meta):
        ap.error("give --data, or --panel and --meta")
    spark = SparkSession.builder.getOrCreate()
    dates = {"train_to": args.train_to, "bookings_from": args.bookings_from, "horizon_from": args.horizon_from,
             "uplift_years": tuple(args.uplift_years)}
    inputs = replace(from_tables(spark, args.data), **dates) if args.data else from_csv(
        spark, args.panel, args.meta, args.out, args.groupings, **dates)
    for name, path in build_report(spark, inputs, args.out, args.k).items():
        print(name, path)


if __name__ == "__main__":
    main()
