"""Training-data operators: ten corpus-scale steps, each in a module of its own."""
