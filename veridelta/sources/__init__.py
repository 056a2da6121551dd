"""Readers and writers between documents and the long table of assertions."""
