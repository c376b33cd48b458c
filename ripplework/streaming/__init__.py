"""Changes: folding a log into a table, the difference of two states, and views kept current over a stream."""
