"""kvlake: versioned key-value data on Spark DataFrames."""

from .schema import EngineOptions, KvError  # noqa: F401
