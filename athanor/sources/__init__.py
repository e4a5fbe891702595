"""Readers of molecule lists, mappings and the rule catalog."""
