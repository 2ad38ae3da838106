"""DataFrame operators: rules, correlation, graph, vectors and data quality."""
