"""tallyframe: account-ledger analytics as Spark DataFrame / SQL jobs."""

__version__ = "0.1.0"
