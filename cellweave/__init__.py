"""cellweave: evaluation-grid analytics and response-corpus operators, declared on the Spark DataFrame API."""

__version__ = "0.1.0"
