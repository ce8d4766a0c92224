"""Operators for preparing language-model training data.

One module per operator, each with its operator, the query registered for it and, where SQL can say the
same, its SQL.  `queries.py` gathers them.  Nothing else in the package imports from here."""
