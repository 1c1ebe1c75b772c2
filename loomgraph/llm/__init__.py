"""Training-data operators: ten corpus operators and the helpers they share.

Nothing outside this subpackage imports it.
"""
