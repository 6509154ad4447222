"""Morphlake: dictionary- and rule-driven text analytics on PySpark."""
