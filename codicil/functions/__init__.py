"""Part of the codicil engine."""
