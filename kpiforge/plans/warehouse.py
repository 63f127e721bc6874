"""Materialize star tables as Parquet in a shared folder.

Every table is a step: the raw tables and written tables it reads, and a builder.
Writing a table cuts lineage: a lost executor costs at most the step being written,
never a replay from the raw files. Steps that do not depend on each other are written
at the same time. Lookups are written before the tables that join them, so the planner
sees their real (file) size and broadcasts them only under the broadcast threshold.

A result needs some tables only: ``TableStore`` builds the closure of what is asked
for, and knows every table by a fingerprint of its raw files and of the steps behind
it, so that changed input is seen and unchanged tables are used again.
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.operators.checks import Measured, measure
from kpiforge.operators.lookup import numbered, ordered_names
from kpiforge.operators.quantiles import in_buckets
from kpiforge.plans import star as S
from kpiforge.plans.blocks import BLOCKS
from kpiforge.plans.versions import Manifest, VersionedFolder
from kpiforge.schemas import RAW_NAMES, checked_columns
from kpiforge.session import checkpoint_root

MAX_JOBS = 4  # tables written at the same time

#: Rows of a file of the usage tables at most. The steps after them sort or combine the rows of a
#: task in memory, and 128 MB of Parquet, the most a task reads, can hold ten million. A task
#: reads 32 files at most (every file counts as 4 MB more), so under two million rows, whatever the size.
ROWS_PER_FILE = {"_usage_with_account": 60_000, "fact_feature_usage": 60_000}


@dataclass(frozen=True)
class Step:
    """How a table comes about: raw tables and written tables it reads, builder of the written tables."""

    raw: tuple[str, ...]
    reads: tuple[str, ...]
    build: Callable[[S.RawTables, Mapping[str, DataFrame]], DataFrame]


def _lookup_steps(name: str) -> dict[str, Step]:
    """A lookup's distinct names in order, and the table that numbers them."""
    id_col, name_col = S.lookup_columns(name)
    staged = f"_names_{name}"
    return {
        staged: Step(S.LOOKUP_SOURCES[name][0], (), lambda raw, o: ordered_names(S.lookup_names(raw, name), name_col)),
        name: Step((), (staged,), lambda raw, o: numbered(o[staged], id_col, name_col)),
    }


def _block_step(name: str, *reads: str) -> dict[str, Step]:
    return {name: Step((), reads, lambda raw, o: BLOCKS[name](S.StarSchema(o)))}


# Every table is listed after the tables it reads.
STEPS: dict[str, Step] = {
    # The longest chain comes first. Raw usage meets subscriptions once; the usage fact and
    # the summary read the result.
    "_hot_subscriptions": Step(("feature_usage", "subscriptions"), (), lambda raw, o: S.hot_subscriptions(raw)),
    "_usage_with_account": Step(("feature_usage", "subscriptions"), ("_hot_subscriptions",),
                                lambda raw, o: S.usage_with_account(raw, o["_hot_subscriptions"])),
    # The summary is staged without tiers; thresholds and tiers then read the finished copy.
    "_account_summary": Step(("accounts", "subscriptions", "support_tickets", "churn_events"), ("_usage_with_account",),
                             lambda raw, o: S.account_summary_base(raw, o["_usage_with_account"])),
    "_threshold_counts": Step((), ("_account_summary",),
                              lambda raw, o: in_buckets(S.threshold_counts(o["_account_summary"]))),
    "risk_thresholds": Step((), ("_threshold_counts",), lambda raw, o: S.thresholds_of(o["_threshold_counts"])),
    "fact_account_summary": Step((), ("_account_summary", "risk_thresholds"),
                                 lambda raw, o: S.with_risk_tier(o["_account_summary"], o["risk_thresholds"])),
    **{k: step for name in S.LOOKUPS for k, step in _lookup_steps(name).items()},
    "fact_subscriptions": Step(("subscriptions",), ("dim_plan_tier",),
                               lambda raw, o: S.fact_subscriptions(raw, o["dim_plan_tier"])),
    "dim_date": Step(("accounts", "subscriptions", "support_tickets", "churn_events"), (),
                     lambda raw, o: S.dim_date(raw)),
    # Small monthly blocks shared by several KPIs, from the written facts.
    **_block_step("blk_monthly_snapshot", "fact_subscriptions", "dim_date"),
    **_block_step("blk_mrr_movement", "fact_subscriptions"),
    **_block_step("blk_churned_by_month", "fact_subscriptions"),
    "fact_feature_usage": Step((), ("_usage_with_account",),
                               lambda raw, o: S.fact_feature_usage(raw, o["_usage_with_account"])),
    **_block_step("blk_usage_by_account_feature", "fact_feature_usage"),
    "fact_support_tickets": Step(("support_tickets",), (), lambda raw, o: S.fact_support_tickets(raw)),
    "fact_churn_events": Step(("churn_events",), ("dim_reason_code",),
                              lambda raw, o: S.fact_churn_events(raw, o["dim_reason_code"])),
    "dim_account": Step(("accounts",), ("dim_industry", "dim_referral_source", "dim_plan_tier"),
                        lambda raw, o: S.dim_account(raw, o["dim_industry"], o["dim_referral_source"],
                                                     o["dim_plan_tier"])),
}

#: What a finished star holds; the other steps are scratch of the build.
PUBLISHED = (*S.STAR_TABLES, "risk_thresholds", *BLOCKS)

#: Fact -> date by which its rows may be clustered.
CLUSTER_DATES = {"fact_subscriptions": "start_date", "fact_feature_usage": "usage_date",
                 "fact_support_tickets": "ticket_date", "fact_churn_events": "churn_date"}


def closure(names: Iterable[str]) -> list[str]:
    """The steps behind ``names``, each after those it reads."""
    needed, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo.extend(STEPS[name].reads)
    return [n for n in STEPS if n in needed]


def _write(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    (df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
     .parquet(path))


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Overwrite ``path`` with ``df`` (idempotent rebuild) and read it back."""
    _write(df, path)
    return df.sparkSession.read.parquet(path)


def write_measured(df: DataFrame, path: str, name: str) -> tuple[DataFrame, Measured]:
    """``write_table``, with the rows and non-null keys counted by the tasks that write."""
    counted = measure(df, checked_columns(name), lambda d: _write(d, path, ROWS_PER_FILE.get(name, 0)))
    return df.sparkSession.read.parquet(path), counted


def clustered_by_month(df: DataFrame, date: str) -> DataFrame:
    """Rows dealt out by month and then by a hash of the row, and put in order of the date.

    A file then holds few months, so the statistics in its footer let a filter
    on the date skip it; the hash lets a month with many rows fill many files.
    """
    spread = F.xxhash64(*df.columns)
    return (df.withColumn("__spread", spread)
            .repartitionByRange(F.trunc(date, "month"), F.col("__spread"))
            .sortWithinPartitions(date).drop("__spread"))


def _run(steps: list[str], one: Callable[[str], object], jobs: int) -> None:
    """Call ``one`` for each step once those of ``steps`` that it reads are done, at most ``jobs`` at a time.

    Of the steps that can run, those listed first are taken first.
    """
    open_steps, running, done = list(steps), {}, set()
    with ThreadPoolExecutor(max_workers=max(1, jobs)) as pool:
        while open_steps or running:
            ready = [n for n in open_steps if not (set(STEPS[n].reads) & set(steps)) - done]
            for name in ready[:max(1, jobs) - len(running)]:
                open_steps.remove(name)
                running[pool.submit(one, name)] = name
            ended, _ = wait(running, return_when=FIRST_COMPLETED)
            for future in ended:
                done.add(running.pop(future))
                future.result()


def build_version(raw: S.RawTables, folder: str, max_concurrent_jobs: int = MAX_JOBS,
                  by_month: bool = False) -> S.StarSchema:
    """Write every star table below ``folder``; nothing is published."""
    out: dict[str, DataFrame] = {}
    measured: dict[str, Measured] = {}

    def one(name: str) -> None:
        df = STEPS[name].build(raw, out)
        if by_month and name in CLUSTER_DATES:
            df = clustered_by_month(df, CLUSTER_DATES[name])
        out[name], measured[name] = write_measured(df, f"{folder}/{name}", name)

    _run(list(STEPS), one, max_concurrent_jobs)
    return S.StarSchema({n: out[n] for n in PUBLISHED}, {n: measured[n] for n in PUBLISHED})


def materialize_star(raw: S.RawTables, path: str, max_concurrent_jobs: int = MAX_JOBS, by_month: bool = False,
                     stage_raw: Callable[[S.RawTables, str], S.RawTables] | None = None,
                     before_publish: Callable[[S.StarSchema, str], None] | None = None) -> S.StarSchema:
    """Build every star table as a new version below ``path``, then publish it.

    ``stage_raw`` may write the raw tables below a folder first. ``before_publish``
    gets the new star and its folder; when it raises, or the build does, the version
    published before stays what readers see and the new one is removed. Tables that
    only the build needs go when it is published.
    """
    spark = raw.accounts.sparkSession
    root = VersionedFolder(spark, path)
    version = root.new_version()
    folder = root.folder(version)
    try:
        if stage_raw is not None:
            raw = stage_raw(raw, f"{folder}/_raw")
        star = build_version(raw, folder, max_concurrent_jobs, by_month)
        if before_publish is not None:
            before_publish(star, folder)
    except BaseException:
        root.discard(version)
        raise
    root.publish(Manifest(version, {n: f"data/{version}/{n}" for n in PUBLISHED}, star.measured))
    for scratch in ("_raw", *(n for n in STEPS if n not in PUBLISHED)):
        root.discard(f"{version}/{scratch}")
    return star


class NoStarError(RuntimeError):
    """No star schema was published below a folder."""


def open_star(spark: SparkSession, path: str) -> S.StarSchema:
    """The star schema last published below ``path``."""
    root = VersionedFolder(spark, path)
    manifest = root.current()
    if manifest is None:
        raise NoStarError(f"no star schema was published below {path}")
    return S.StarSchema({n: spark.read.parquet(f"{root.root}/{at}") for n, at in manifest.tables.items()},
                        manifest.measured)


def register_views(star: S.StarSchema) -> None:
    """Expose every star table as a temporary view for ad-hoc Spark SQL."""
    for name, df in star.items():
        df.createOrReplaceTempView(name)


# ------------------------------------------------------- tables built on demand

def files_fingerprint(df: DataFrame) -> str:
    """Digest of name, length and time of change of the files a table is read from."""
    sc = df.sparkSession.sparkContext
    conf, path_of = sc._jsc.hadoopConfiguration(), sc._jvm.org.apache.hadoop.fs.Path
    seen = []
    for name in sorted(df.inputFiles()):
        path = path_of(sc._jvm.java.net.URI(name))
        status = path.getFileSystem(conf).getFileStatus(path)
        seen.append(f"{name}|{status.getLen()}|{status.getModificationTime()}")
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()


class TableStore:
    """Star tables written on demand, each known by the fingerprint of what it was made from."""

    def __init__(self, root: str, max_concurrent_jobs: int = MAX_JOBS):
        self.root, self.jobs = root.rstrip("/"), max_concurrent_jobs
        self.built: list[str] = []  # names in the order they were written
        self._held: dict[str, tuple[DataFrame, Measured]] = {}
        self._lock = threading.RLock()

    def fingerprints(self, raw: S.RawTables) -> dict[str, str]:
        """Fingerprint of every table: its name, its raw files, the fingerprints of the tables it reads."""
        files = {n: files_fingerprint(getattr(raw, n)) for n in RAW_NAMES}
        marks: dict[str, str] = {}
        for name, step in STEPS.items():
            parts = [name, *(files[r] for r in step.raw), *(marks[r] for r in step.reads)]
            marks[name] = hashlib.sha256("|".join(parts).encode()).hexdigest()
        return marks

    def need(self, raw: S.RawTables, marks: Mapping[str, str], name: str) -> tuple[DataFrame, Measured]:
        """The table, after writing what is missing of its closure."""
        with self._lock:
            if marks[name] in self._held:
                return self._held[marks[name]]
            lacking = self._lacking(marks, name)

            def one(step: str) -> None:
                if marks[step] in self._held:
                    return
                out = {r: self._held[marks[r]][0] for r in STEPS[step].reads}
                path = f"{self.root}/{step}-{marks[step][:12]}-{uuid.uuid4().hex[:8]}"
                self._held[marks[step]] = write_measured(STEPS[step].build(raw, out), path, step)
                self.built.append(step)

            _run(lacking, one, self.jobs)
            return self._held[marks[name]]

    def _lacking(self, marks: Mapping[str, str], name: str) -> list[str]:
        """Steps of the closure that are not held, without those that only held tables need."""
        needed, todo = set(), [name]
        while todo:
            step = todo.pop()
            if step not in needed and marks[step] not in self._held:
                needed.add(step)
                todo.extend(STEPS[step].reads)
        return [n for n in STEPS if n in needed]


class StarOnDemand(S.StarSchema):
    """A star schema whose tables are written when they are first looked at."""

    def __init__(self, raw: S.RawTables, store: TableStore):
        super().__init__({})
        self._raw, self._store = raw, store
        self._marks = store.fingerprints(raw)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in PUBLISHED:
            raise KeyError(name)
        df, self.measured[name] = self._store.need(self._raw, self._marks, name)
        return df

    def __contains__(self, name: object) -> bool:
        return name in PUBLISHED

    def __iter__(self) -> Iterator[str]:
        return iter(PUBLISHED)

    def __len__(self) -> int:
        return len(PUBLISHED)

    def __getattr__(self, name: str) -> DataFrame:
        if name in PUBLISHED:
            return self[name]
        raise AttributeError(name)


_stores: dict[str, TableStore] = {}
_lock = threading.Lock()


def store_of(spark: SparkSession) -> TableStore:
    """The session's store of tables built on demand, below its shared checkpoint folder."""
    app = spark.sparkContext.applicationId
    with _lock:
        if app not in _stores:
            _stores[app] = TableStore(f"{checkpoint_root(spark).rstrip('/')}/star-{uuid.uuid4().hex[:12]}")
        return _stores[app]


def star_for(spark: SparkSession, sf_dir: str) -> StarOnDemand:
    """The star schema of a test-data folder as its files are now; tables are written when needed."""
    from kpiforge.sources.fixtures import raw_from_testdata

    return StarOnDemand(raw_from_testdata(spark, sf_dir), store_of(spark))
