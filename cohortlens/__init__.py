"""cohortlens — activity analytics over discussion archives, built on Spark SQL.

Every operator is a function ``DataFrame -> DataFrame`` (or a column-expression
builder).  Nothing is collected on the driver: global scalars are one-row
aggregates joined back, rankings use ``limit`` (TakeOrderedAndProject), and
per-author work is shuffled on the author key with map-side partial aggregation.
"""

__version__ = "0.1.0"
