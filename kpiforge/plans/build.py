"""End-to-end job: load raw files, build the star schema, write every result set.

    python -m kpiforge.plans.build --raw <dir> --format csv --out <dir> [--prefix exp_]

Steps (each writes Parquet, so a lost executor never replays earlier steps):
1. bulk load: CSV raw tables are parsed once with their declared schemas and
   written as Parquet (every later step reads columns, not text);
2. star schema: lookups, dimensions, facts, account summary with tiers;
3. key checks: the job ends here when a key is NULL or repeated;
4. result sets: the KPIs and checks, one Parquet folder each;
5. publish: star and results become the current version together. Until then,
   and when a step fails, readers see the version published before.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from kpiforge.plans.kpis import CHECKS, KPIS
from kpiforge.plans.star import RawTables, StarSchema
from kpiforge.plans.warehouse import materialize_star, open_star, write_table
from kpiforge.sources.files import load_raw


def stage_raw(raw: RawTables, path: str) -> RawTables:
    """Write the five raw tables once as Parquet and read them back."""
    return RawTables(**{n: write_table(df, f"{path}/{n}") for n, df in raw.as_dict().items()})


class KeyCheckError(RuntimeError):
    """A star table has NULL or repeated keys (the source fails its primary keys here)."""


def validate_keys(star: StarSchema) -> None:
    """Fail the build when any star table key is NULL or repeated.

    Only the check result (one row per key column, 15) reaches the driver.
    """
    from kpiforge.plans.kpis import star_key_checks

    bad = [f"{r.table_name}.{r.key_column}" for r in star_key_checks(star).collect()
           if not (r.key_not_null and r.key_unique)]
    if bad:
        raise KeyCheckError(f"key check failed for: {', '.join(bad)}")


def write_results(star: StarSchema, path: str) -> dict[str, str]:
    out = {}
    for name, fn in {**CHECKS, **KPIS}.items():
        target = f"{path}/{name}"
        fn(star).write.mode("overwrite").parquet(target)
        out[name] = target
    return out


def run(spark: SparkSession, raw_dir: str, fmt: str, out: str, prefixes=(),
        exact_int_money: bool = False, validate: bool = True, by_month: bool = False,
        collation: str | None = None) -> dict[str, str]:
    """Result name -> folder of the published version."""
    out = out.rstrip("/")
    raw = load_raw(spark, raw_dir, fmt, prefixes, exact_int_money, collation)
    paths: dict[str, str] = {}

    def finish(star: StarSchema, folder: str) -> None:
        if validate:
            validate_keys(star)
        paths.update(write_results(star, f"{folder}/results"))

    materialize_star(raw, f"{out}/star", by_month=by_month, stage_raw=stage_raw if fmt == "csv" or collation else None,
                     before_publish=finish)
    return paths


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--raw", required=True, help="folder holding the five raw tables")
    ap.add_argument("--format", default="csv", choices=["csv", "parquet"])
    ap.add_argument("--out", required=True, help="shared output folder")
    ap.add_argument("--prefix", action="append", default=[],
                    help="alternative file-name prefix of the raw tables (repeatable)")
    ap.add_argument("--by-month", action="store_true",
                    help="cluster the fact files by month, so that date filters skip files")
    ap.add_argument("--collation", help="compare text keys by this Spark collation, for example UTF8_LCASE_RTRIM")
    ap.add_argument("--show", action="append", default=[],
                    help="print this result set after the build (repeatable)")
    args = ap.parse_args(argv)
    from kpiforge.session import get_session

    spark = get_session()
    paths = run(spark, args.raw, args.format, args.out, args.prefix, by_month=args.by_month,
                collation=args.collation)
    for name, path in paths.items():
        print(f"{name}\t{path}")
    star = open_star(spark, f"{args.out.rstrip('/')}/star")
    for name in args.show:  # whole, in the result's own order
        result = {**CHECKS, **KPIS}[name](star)
        result.show(result.count(), truncate=False)


if __name__ == "__main__":
    main()
