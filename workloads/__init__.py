"""Driver queries over the test tables, each with its reference SQL."""
