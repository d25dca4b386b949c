"""D — relation comparison: schema, keys, rows as multisets, aggregates,
edge cases and the check roll-up."""

from .rows import CompareConfig, RowComparison, compare_rows, key_presence  # noqa: F401
