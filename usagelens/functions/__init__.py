"""Column expressions: labels, local time, pricing and JSON token counts."""
