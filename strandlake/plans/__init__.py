"""Strandlake plans."""
