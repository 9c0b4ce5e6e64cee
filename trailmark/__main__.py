"""python -m trailmark STEP --config FILE: a step of a study, an aid, or all steps in their order."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import jobs
from .config import Config


def main(argv: list[str] | None = None) -> int:
    names = [*jobs.STEPS, "all", *jobs.AIDS]
    told = "; ".join(f"{n}: {(f.__doc__ or '').splitlines()[0]}" for n, f in (jobs.STEPS | jobs.AIDS).items())
    ap = argparse.ArgumentParser(prog="trailmark", description=__doc__)
    ap.add_argument("step", choices=names, help=told.replace("%", "%%"))
    ap.add_argument("--config", default="config.yaml", help="the study's settings")
    ap.add_argument("--again", action="store_true", help="fetch anew what is there")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("trailmark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for name, seconds in jobs.run(jobs.Study(spark, Config.read(args.config), args.again), args.step).items():
        print(f"{name}: {seconds:.1f} s")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
