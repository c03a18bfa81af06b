"""Readers, writers and the two input views of the engine."""

from mixlens.sources.tables import (
    read_table, product_series, meta_series, variable_groupings,
    DRIVER_GROUPS, DRIVER_ORDER, TERM_GROUPS,
)
from mixlens.sources.io import (
    PANEL_SCHEMA, META_SCHEMA, read_panel_csv, read_meta_csv, read_groupings_csv,
    write_segments_csv, write_models, read_models, answer_sheet,
)

__all__ = [
    "read_table", "product_series", "meta_series", "variable_groupings",
    "DRIVER_GROUPS", "DRIVER_ORDER", "TERM_GROUPS",
    "PANEL_SCHEMA", "META_SCHEMA", "read_panel_csv", "read_meta_csv", "read_groupings_csv",
    "write_segments_csv", "write_models", "read_models", "answer_sheet",
]
