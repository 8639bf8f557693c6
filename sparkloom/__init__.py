"""Property-graph, text and evidence analytics as DataFrame operators."""
