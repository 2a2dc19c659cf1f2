"""Training-data operators: ten DataFrame-in, DataFrame-out components for preparing text corpora.

Nothing else in the library imports this subpackage.
"""
