"""Weftline: panel analytics on attributed networks, as Spark plans."""
