"""Expressions that other modules share."""

from mortise.operators.ensembles import blend
from mortise.operators.statistics import average_rank, clean_category, metrics, quantile, summary
from mortise.operators.texts import to_ev

__all__ = ["average_rank", "blend", "clean_category", "metrics", "quantile", "summary", "to_ev"]
