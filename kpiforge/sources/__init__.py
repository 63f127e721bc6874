"""Input sources: raw CSV/Parquet tables and the test-data adapter."""

from kpiforge.sources.files import load_raw, read_raw_table, require_columns, resolve_source
from kpiforge.sources.fixtures import raw_from_testdata

__all__ = ["load_raw", "read_raw_table", "require_columns", "resolve_source", "raw_from_testdata"]
