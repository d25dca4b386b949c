"""concord — migration assurance on Spark.

Compare a source and a migrated target table (or many pairs at once),
classify what differs, and roll the findings up into scores and gates.
Everything is a DataFrame transformation; no row data is collected.
"""

__version__ = "0.1.0"
