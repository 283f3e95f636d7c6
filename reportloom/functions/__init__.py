"""Column functions: expressions only, nothing here triggers a job."""
