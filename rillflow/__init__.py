"""Network-flow features and large-scale table pipelines on Spark."""
