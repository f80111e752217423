"""Training-data operators: one module per operator, each with the general
operator, the registered query and, where SQL can express it, its oracle."""
