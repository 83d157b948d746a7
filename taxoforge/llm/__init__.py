"""Training-data operators: each module holds one operator with a general interface.

Nothing else in the package imports this subpackage.
"""
