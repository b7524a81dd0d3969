"""Column expressions. All of them are built-in functions, so they stay inside generated code."""
