"""Column expressions: codecs, scalar text functions, fixed values."""
