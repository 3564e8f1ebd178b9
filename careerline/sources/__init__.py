"""Text files in, versioned Parquet tables out."""
