"""ledgerlens: journal-entry testing on Spark.

Stages are DataFrame -> DataFrame functions built from native Spark
expressions: ingest (sources), map + validate, standardise + enrich
(operators), and view compilation (operators.view / plans.spec).
"""

__version__ = "0.1.0"
