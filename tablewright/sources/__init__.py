"""Where rows come from: CSV text, object tables, generated facts."""
