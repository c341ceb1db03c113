"""The named steps of a pipeline."""
