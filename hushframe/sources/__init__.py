from .tables import (
    append_tables,
    as_text,
    check_headings,
    check_row_shape,
    conversion_counters,
    list_tables,
    load_related,
    load_table,
    row_shape_counts,
    unsafe_cells,
)
from .rows import with_row_number

__all__ = [
    "append_tables",
    "as_text",
    "check_headings",
    "check_row_shape",
    "conversion_counters",
    "list_tables",
    "load_related",
    "load_table",
    "row_shape_counts",
    "unsafe_cells",
    "with_row_number",
]
