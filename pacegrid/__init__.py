"""pacegrid: a PySpark engine for event-listing extraction, entity resolution and search."""
