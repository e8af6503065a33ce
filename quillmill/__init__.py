"""Corpus building and evaluation operators for Spark DataFrames."""
