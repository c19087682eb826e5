"""Part of the vitrine engine."""
