"""Registered queries over the driver's tables and small literal fixtures, with their DuckDB SQL."""
