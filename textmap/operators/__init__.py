"""DataFrame operators: text, vectors, ranking, space, regression."""
