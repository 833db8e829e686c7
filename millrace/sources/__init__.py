from millrace.sources.delimited import (
    MULTILINE,
    Landed,
    guess_csv_table,
    header_groups,
    infer_csv_schema,
    land_csv,
    read_csv_table,
)
from millrace.sources.jdbc import read_jdbc_table
from millrace.sources.listing import list_files

__all__ = [
    "MULTILINE",
    "Landed",
    "guess_csv_table",
    "header_groups",
    "infer_csv_schema",
    "land_csv",
    "list_files",
    "read_csv_table",
    "read_jdbc_table",
]
