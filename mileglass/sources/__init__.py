"""Table and file sources, batch and layer sinks."""
