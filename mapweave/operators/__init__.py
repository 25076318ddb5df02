"""DataFrame operators: one function per join, aggregation, window or graph operator."""
