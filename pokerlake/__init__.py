"""Poker-hand analytics on Spark DataFrames."""
