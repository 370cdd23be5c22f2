from tideline.sources.cohort import normalise_dates, read_cohort, snake_case
from tideline.sources.definitions import add_total_row, definition_filter, read_definitions
from tideline.sources.matched import read_set_stage, write_set_stage
from tideline.sources.reports import concat_tables, read_report, write_report, write_tables
from tideline.sources.stages import kept_stage, materialise, read_stage, run, write_stage

__all__ = [
    "add_total_row", "concat_tables", "definition_filter", "kept_stage", "materialise", "normalise_dates",
    "read_cohort", "read_definitions", "read_report", "read_set_stage", "read_stage", "run", "snake_case", "write_report",
    "write_set_stage", "write_stage", "write_tables",
]
