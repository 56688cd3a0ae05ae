"""Writers: Parquet layers, catalog layers and JDBC. Write failures reach the caller."""
