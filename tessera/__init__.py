"""tessera: claim graphs, commitments, metrics, search and roll-ups as Spark DataFrame operators."""
