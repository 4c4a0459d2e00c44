"""Where tables come from: line files, parquet folders, catalogues."""
