"""Documents: from partial results to records, and from records to the layouts of other catalogues."""
