"""Column expressions: null tokens, guarded casts, identifiers."""
