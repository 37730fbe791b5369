"""The jobs, one module per subject."""
