"""Training-data operators: text, embedding and corpus-mix stages on Spark."""
