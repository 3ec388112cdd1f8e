"""Column expressions: exact rounding, ordered totals, bands, text and vectors."""
