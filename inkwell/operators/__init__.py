from inkwell.operators import aggregates, clusters, features, graph, joins, rows, similarity, tokens, topics

__all__ = ["aggregates", "clusters", "features", "graph", "joins", "rows", "similarity", "tokens", "topics"]
