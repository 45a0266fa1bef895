"""Corpus building and corpus scoring for speech-and-text data on Spark."""
