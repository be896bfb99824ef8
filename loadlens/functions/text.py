"""Column expressions on log text and run labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0      "
    "          　"
)

# Fixed value: run folders are named <phase>_<YYYY-MM-DD_HH-MM-SS>.
RUN_FOLDER = r"([^/]+)_(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})/[^/]*$"
RUN_STAMP = "yyyy-MM-dd_HH-mm-ss"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def phase_label(phase: Column) -> Column:
    return F.replace(phase, F.lit("."), F.lit("_"))


def is_synced(phase: Column, suffix: str = ".sync") -> Column:
    return F.when(phase.endswith(suffix), "sync").otherwise("disabled")


def is_perturbed(phase: Column) -> Column:
    return phase.startswith("perturbed")


def run_phase(path: Column) -> Column:
    """Phase label of the run folder a file lies in; NULL for other paths."""
    return F.nullif(F.regexp_extract(path, RUN_FOLDER, 1), F.lit(""))


def run_started(path: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(path, RUN_FOLDER, 2), F.lit(RUN_STAMP))
