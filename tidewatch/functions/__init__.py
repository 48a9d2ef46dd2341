"""Column expressions and small closed formulas."""
