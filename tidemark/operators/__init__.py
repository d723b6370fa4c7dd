"""Detection, aggregation, graph, retrieval and workflow operators."""
