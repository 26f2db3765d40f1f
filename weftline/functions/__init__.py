"""Pure builders of column expressions."""
