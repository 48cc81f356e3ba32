"""Evidence analytics on Spark: ledgers, retrieval, ranking, graphs and corpus pipelines as DataFrame plans."""
