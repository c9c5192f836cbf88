"""loomgraph: topic models of documents that live on a graph, as PySpark DataFrame plans."""
