"""Writers: CSV, stage folders, versioned tables, top-N results."""
