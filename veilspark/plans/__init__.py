"""Whole flows: scan a folder, and make clean copies of what a scan saw."""
