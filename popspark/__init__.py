"""Population simulation and survey estimation as DataFrame transformations."""
