"""Where rows go: CSV text, object tables, feed batches, run statistics."""
