from millrace.functions.columns import (
    file_name,
    first_match,
    parsed_timestamp,
    positive,
    target_table,
)

__all__ = ["file_name", "first_match", "parsed_timestamp", "positive", "target_table"]
