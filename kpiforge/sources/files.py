"""Raw table files: name resolution, typed CSV/Parquet reads, input checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiforge.operators.quantiles import union_all
from kpiforge.schemas import RAW_NAMES, raw_schemas


class MissingInputError(RuntimeError):
    """A required raw table or column is absent."""


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def resolve_source(spark: SparkSession, root: str, logical: str, fmt: str,
                   prefixes: Iterable[str] = ()) -> str:
    """First existing path among ``<root>/<name>`` and ``<root>/<prefix><name>``.

    The plain name wins when both exist (an exported file named after its
    source may carry a prefix; the plain name is the canonical one).
    """
    stems = [logical] + [f"{p}{logical}" for p in prefixes]
    candidates = []
    for stem in stems:
        candidates += [f"{root.rstrip('/')}/{stem}.{fmt}", f"{root.rstrip('/')}/{stem}"]
    for path in candidates:
        if _exists(spark, path):
            return path
    raise MissingInputError(
        f"raw table '{logical}' not found under {root} (tried {', '.join(candidates)})")


# Spellings accepted for BIT (boolean) columns in text files.
_TRUE = ["1", "true", "t", "yes", "y"]
_FALSE = ["0", "false", "f", "no", "n"]


def _bit(c: str):
    v = F.lower(F.trim(F.col(c)))
    return (F.when(F.col(c).isNull() | (v == ""), F.lit(None).cast("boolean"))
             .when(v.isin(_TRUE), F.lit(True))
             .when(v.isin(_FALSE), F.lit(False))
             .otherwise(F.raise_error(F.concat(F.lit(f"not a boolean in column {c}: "),
                                               F.col(c)))).cast("boolean"))


def _csv_reader(spark: SparkSession):
    return spark.read.option("header", True).option("sep", ",").option("encoding", "UTF-8")


def _data_files(spark: SparkSession, path: str) -> list[str]:
    """Files of a table: the path itself, or the files of the folder that Spark would read."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s for s in fs.listStatus(jpath) if s.isFile()]
    return sorted(s.getPath().toString() for s in found
                  if fs.getFileStatus(jpath).isFile() or not s.getPath().getName().startswith(("_", ".")))


def _first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a text file, packed or not; None if it is empty. Reads one buffer of the file."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    stream = jpath.getFileSystem(conf).open(jpath)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(jpath)
        source = stream if codec is None else codec.createInputStream(stream)
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(source, "UTF-8")).readLine()
    finally:
        stream.close()


def _by_header(spark: SparkSession, path: str) -> list[list[str]]:
    """The files of a table, those with the same header line together; empty files are left out.

    Only the first line of each file is read here, some files at a time.
    """
    files = _data_files(spark, path)
    with ThreadPoolExecutor(max_workers=16) as pool:
        headers = list(pool.map(lambda f: _first_line(spark, f), files))
    groups: dict[str, list[str]] = {}
    for name, header in zip(files, headers):
        if header is not None:
            groups.setdefault(header, []).append(name)
    return list(groups.values())


def _read_csv_group(spark: SparkSession, files: list[str], schema: T.StructType) -> DataFrame:
    """Typed read of files that share a header; columns are bound by its names."""
    header = _csv_reader(spark).csv(files[0])
    require_columns({files[0]: header}, {files[0]: schema.fieldNames()})
    bits = {f.name for f in schema.fields if isinstance(f.dataType, T.BooleanType)}
    declared = {f.name: f.dataType for f in schema.fields if f.name not in bits}
    file_schema = T.StructType([T.StructField(c, declared.get(c, T.StringType()), True)
                                for c in header.columns])
    df = (_csv_reader(spark).schema(file_schema).option("enforceSchema", False)
          .option("mode", "FAILFAST").csv(files))
    return df.select([_bit(f.name).alias(f.name) if f.name in bits else F.col(f.name)
                      for f in schema.fields])


def read_raw_table(spark: SparkSession, path: str, schema: T.StructType,
                   fmt: str = "csv") -> DataFrame:
    """Typed read: CSV with a header row, comma, UTF-8, no inference; or Parquet.

    CSV columns are bound by the names in the header: they may come in any
    order and among others, and a declared column that a header lacks fails
    here, before anything is built. The files of a table may differ in their
    headers: those with one header are read together and the reads are united.
    CSV boolean (BIT) columns accept 1/0 as well as true/false (any case); any
    other value fails the read, like every other malformed field.
    """
    if fmt == "csv":
        groups = _by_header(spark, path)
        if not groups:
            raise MissingInputError(f"no file with a header below {path}")
        return union_all([_read_csv_group(spark, files, schema) for files in groups])
    if fmt == "parquet":
        df = spark.read.parquet(path)
        require_columns({path: df}, {path: schema.fieldNames()})
        return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
    raise ValueError(f"unsupported format {fmt!r}")


def require_columns(tables: Mapping[str, DataFrame],
                    required: Mapping[str, Iterable[str]]) -> None:
    """Fail before building when a table or a required column is missing."""
    for name, cols in required.items():
        if name not in tables or tables[name] is None:
            raise MissingInputError(f"required input table '{name}' is missing")
        have = set(tables[name].columns)
        missing = [c for c in cols if c not in have]
        if missing:
            raise MissingInputError(f"table '{name}' lacks required columns {missing}")


def load_raw(spark: SparkSession, root: str, fmt: str = "csv", prefixes: Iterable[str] = (),
             exact_int_money: bool = False, collation: str | None = None):
    """Load the five raw tables from ``root`` (CSV or Parquet) with declared types.

    With a ``collation`` (see ``kpiforge.sources.collation``) text keys that are
    equal under it get one spelling.
    """
    from kpiforge.plans.star import RawTables

    schemas = raw_schemas(exact_int_money)
    frames = {}
    for name in RAW_NAMES:
        path = resolve_source(spark, root, name, fmt, prefixes)
        frames[name] = read_raw_table(spark, path, schemas[name], fmt)
    require_columns(frames, {n: s.fieldNames() for n, s in schemas.items()})
    raw = RawTables(**frames)
    if collation is None:
        return raw
    from kpiforge.sources.collation import with_collation

    return with_collation(raw, collation)
