"""chainlens: supply-chain metrics, marts and reports as Spark DataFrame plans.

Every public function takes DataFrames (or a SparkSession plus a path) and
returns a lazy DataFrame.  Nothing is collected to the driver in the core;
actions happen only at writes or when the caller asks for rows.
"""

__version__ = "0.1.0"
