"""Review analytics on Spark.

Operators are plain DataFrame -> DataFrame functions over a multi-store
``reviews`` table keyed by ``slug``; see README.md for the catalogue.
"""

from reviewlens.config import DEFAULT, AnalysisConfig  # noqa: F401

__all__ = ["AnalysisConfig", "DEFAULT"]
