"""Training-data operators over document, page and conversation tables.

Nothing outside this package imports it. Operators take and return DataFrames;
text work that Catalyst has no expression for runs in ``mapInArrow`` over numpy
arrays, and everything that moves between rows is an ordinary Spark shuffle.
"""
