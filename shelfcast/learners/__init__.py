"""Model training, scoring and storage."""

from .training import (
    BEST, BOOSTED, FOREST, LOGISTIC,
    ShortageModel, assembler, balanced, fit_boosted, fit_forest, fit_logistic, load_model,
    positives_weighted, save_model, score,
)

__all__ = [name for name in dir() if not name.startswith("_")]
