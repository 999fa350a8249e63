"""Pages that arrive while an assessment runs."""
