"""The analyses, composed from the operators."""
