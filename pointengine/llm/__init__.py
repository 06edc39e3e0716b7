"""Training-data operators over document, label and embedding tables.

Nothing outside this subpackage imports it.
"""
