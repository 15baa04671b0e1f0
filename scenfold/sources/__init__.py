"""Sources and sinks: scenario registry, symbol loading, the star-schema catalog, CSV."""
