"""weftwork: feature extraction and analytics over nested, graph-shaped records on Spark."""
