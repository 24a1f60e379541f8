"""Usage metering and quota analytics as Spark jobs.

Every public function takes DataFrames and returns DataFrames.  The report
zone, the report date and the price book are always arguments.
"""

__version__ = "0.1.0"
