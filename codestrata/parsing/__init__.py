"""Source text to record sets, as column expressions over a table of lines."""
