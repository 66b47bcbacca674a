"""Relational, text and graph operators over DataFrames."""
