"""folio: batch document processing and analytics on PySpark DataFrames."""
