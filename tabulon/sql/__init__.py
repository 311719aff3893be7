"""From SQL text to a syntax tree."""
