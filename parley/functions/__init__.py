"""Column expressions: text primitives, rounding, conversation features, line validation."""
