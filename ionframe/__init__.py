"""Spark-native analytics for mass-spectrometry features, scans and spectra."""
