"""vitrine: multimodal retrieval and corpus analytics on Spark DataFrames."""
