"""Word lists, patterns and lookup tables the results depend on."""
