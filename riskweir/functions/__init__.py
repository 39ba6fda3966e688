"""Column expressions: typed coercion and small scalar helpers."""
