"""quarry: knowledge-graph, hybrid-retrieval and corpus analytics on PySpark."""
