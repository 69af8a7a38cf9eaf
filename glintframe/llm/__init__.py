"""Training-data operators: ten distributed corpus jobs over ``documents``-shaped tables.

Nothing outside this subpackage imports it.
"""
