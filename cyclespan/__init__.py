"""Cyclespan: analytics of directed money-transfer graphs, and of text corpora, as Spark DataFrames."""
