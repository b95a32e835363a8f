"""From SQL text to a syntax tree, in the dialect's surface."""
