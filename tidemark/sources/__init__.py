"""Bar tables from files and transaction tables."""
