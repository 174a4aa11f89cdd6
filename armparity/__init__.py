"""armparity: compare two arms of recorded model calls on Spark."""

__version__ = "0.1.0"
