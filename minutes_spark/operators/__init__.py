"""DataFrame operators: text, entity resolution, counting and state."""
