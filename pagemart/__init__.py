"""pagemart: catalogue pages to records, a books table, and reports over it, on Spark."""
