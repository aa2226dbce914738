"""Privacy analytics on Spark: detection, risk, policy, masking, guards and their metrics."""

__version__ = "0.1.0"
