"""procura: procurement reconciliation and document analytics as Spark DataFrame operators.

Every operator is a pure function from DataFrames to a DataFrame; nothing
collects to the driver. Sinks live in :mod:`procura.sources.sinks`.
"""

__version__ = "0.1.0"
