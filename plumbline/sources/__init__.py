"""Where input tables come from."""

from plumbline.sources.files import latest_file
from plumbline.sources.summaries import fold_in, read_summaries
from plumbline.sources.tables import (
    Quarantined,
    read_hierarchy,
    read_mapping,
    read_plan,
    read_results,
    read_with_quarantine,
)

__all__ = [
    "Quarantined",
    "fold_in",
    "latest_file",
    "read_hierarchy",
    "read_mapping",
    "read_plan",
    "read_results",
    "read_summaries",
    "read_with_quarantine",
]
