"""DataFrame operators shared by all comparisons."""

from plumbline.operators.columns import (
    derive,
    drop_columns,
    relocate,
    rename,
    select_any_of,
)
from plumbline.operators.joins import (
    left_join,
    lookup_join,
    semi_join,
    unique_lookup,
)
from plumbline.operators.reshape import names_in, pivot_wider, unpivot_years
from plumbline.operators.rows import (
    absent_after_zero,
    exclude_pairs,
    exclude_within,
    in_year,
    order_rows,
)
from plumbline.operators.storage import stored
from plumbline.operators.sums import sum_by
from plumbline.operators.unions import bind_rows, union_strict

__all__ = [
    "absent_after_zero",
    "bind_rows",
    "derive",
    "drop_columns",
    "exclude_pairs",
    "exclude_within",
    "in_year",
    "left_join",
    "lookup_join",
    "names_in",
    "order_rows",
    "pivot_wider",
    "relocate",
    "rename",
    "select_any_of",
    "semi_join",
    "stored",
    "sum_by",
    "union_strict",
    "unique_lookup",
    "unpivot_years",
]
