"""Preprocessing, models and evaluation over DataFrames."""
