"""tidemark: media sentiment and market anomaly analytics on Spark."""
