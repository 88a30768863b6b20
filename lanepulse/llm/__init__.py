"""Training-data operators: formatting, tokenising, filtering, de-duplicating and packing text.

Nothing else in the library imports this subpackage.
"""
