"""Scoring stored models as a job of its own: no fit, no panel.

    python -m mixlens.plans.score --models /shared/store --meta drivers.csv --out /shared/predictions \\
        [--run run-7] [--horizon-from 2018-01-01] [--scale train|horizon]

The driver series must reach back over the adstock's memory before the horizon.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from mixlens.operators import forecast as FC
from mixlens.operators.features import BOOKINGS_SPEC, HORIZON_FROM, SESSIONS_SPEC, ModelSpec
from mixlens.sources import io as IO


def score(store: IO.ModelStore, specs: tuple[ModelSpec, ...], meta: DataFrame, run: str | None = None,
          scale: str = "train", horizon_from: dt.date = HORIZON_FROM) -> DataFrame:
    """Wide forecast of every target's stored models over the driver series ``meta``."""
    run = run or (store.runs() or [None])[-1]          # one run for all targets
    return FC.forecast({s.target: (store.load(s.target, run), s) for s in specs}, meta, scale, horizon_from)


def main(argv=None):
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--models", required=True, help="folder of the model store")
    ap.add_argument("--meta", required=True, help="driver series CSV (file, folder or glob)")
    ap.add_argument("--out", required=True)
    ap.add_argument("--run", help="run of the store; the latest unless given")
    ap.add_argument("--horizon-from", type=dt.date.fromisoformat, default=HORIZON_FROM)
    ap.add_argument("--scale", choices=("train", "horizon"), default="train")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    drivers = IO.check_meta_csv(spark, args.meta)
    print("rejected driver records:", drivers.rejects.select("file", "record").distinct().count())
    wide = score(IO.ModelStore(spark, args.models), (SESSIONS_SPEC, BOOKINGS_SPEC), drivers.rows, args.run, args.scale, args.horizon_from)
    wide.write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
