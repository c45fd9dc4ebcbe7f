"""Registered queries: each a function of (spark, sf_dir), with DuckDB SQL where SQL can express it."""
