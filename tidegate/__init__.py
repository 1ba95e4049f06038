"""tidegate: streaming-ETL operators over Spark DataFrames.

Every public function takes and returns DataFrames (or Columns).  The same
operator is used in batch and in Structured Streaming wherever Spark allows it.
"""

__version__ = "0.1.0"
