"""Column builders with exact NULL, NaN, zero-sign and overflow behaviour."""
