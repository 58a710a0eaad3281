"""Reports and whole pipelines."""
