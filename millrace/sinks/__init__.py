"""Full-refresh writers.

A sink is a function ``(clean, table)`` that replaces the table's content by
the DataFrame, or raises. Loads count the rows as the sink writes them, so it
has to write ``clean`` or what it makes from it, first and once.
"""

from millrace.sinks.files import overwrite_parquet, publish_view
from millrace.sinks.jdbc import overwrite_jdbc, staged_jdbc
from millrace.sinks.release import Release, current_releases

__all__ = [
    "Release",
    "current_releases",
    "overwrite_jdbc",
    "overwrite_parquet",
    "publish_view",
    "staged_jdbc",
]
