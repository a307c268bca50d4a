"""Regularly sampled series, waveforms and interval labels as Spark DataFrames."""

__version__ = "0.1.0"
