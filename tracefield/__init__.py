"""A PySpark engine for geometric survey data: segments observed on planar
faces, the discs behind them, and the statistics in between."""
