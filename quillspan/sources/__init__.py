"""Where tables come from and go to: saved HTML pages, the Parquet store, published reports."""
