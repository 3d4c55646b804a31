"""inkwell: document-corpus analytics on Spark DataFrames.

``sources``    readers, writers and corpus shaping
``functions``  column expressions (text, vectors) and the Arrow kernels behind them
``operators``  DataFrame in, DataFrame out: tokens, features, graphs, similarity, topics, clusters
``plans``      end-to-end jobs composed of operators
``streaming``  the corpus reader for file streams; every text expression is stateless
"""

from inkwell import functions, operators, plans, sources, streaming
from inkwell.session import ship_kernels

ship_kernels()

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
