"""Column expressions: clock times, rounding, labels and geometry."""
