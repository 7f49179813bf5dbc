"""Set-based Spark operators for catalogues, documents, files, graphs and event streams."""
