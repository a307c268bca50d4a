"""Readers and writers of waveform, label and array files; Parquet is the native format."""
