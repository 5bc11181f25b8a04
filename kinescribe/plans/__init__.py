"""Whole plans: refine, benchmark and extract, the command line, and the registered queries."""
