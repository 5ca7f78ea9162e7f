"""ledgerline: domain analytics as Spark DataFrame/SQL jobs (see README.md)."""

__version__ = "0.1.0"
