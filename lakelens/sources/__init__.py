"""Reading and writing of metadata and data tables."""
