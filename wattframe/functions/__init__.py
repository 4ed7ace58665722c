"""Column-level building blocks: intervals, instants, text and size checks."""
