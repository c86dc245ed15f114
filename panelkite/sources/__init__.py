"""Reading, aligning, ingesting and checking panel tables."""
