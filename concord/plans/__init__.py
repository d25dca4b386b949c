"""Plans: the reference's query idioms (B), the shared derived inputs used
by the driver queries, the validation pipeline (D22/D23) and the query
registry wired into ``__spark_entry__.py``."""
