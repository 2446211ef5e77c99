"""Operators for preparing language-model training data at cluster scale.

Nothing else in the library imports this subpackage.  Every operator takes
and returns DataFrames, selects the columns it names (others may be there,
whatever they are called) and says in its docstring what nulls, empty texts
and repeated rows give.
"""
