"""Column expressions and the few Arrow functions they need."""
