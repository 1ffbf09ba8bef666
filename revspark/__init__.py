"""Review analytics on Spark: ingest, text labelling, scores, trends and anomaly
reports expressed as DataFrame / Structured Streaming operators."""

__version__ = "0.1.0"
