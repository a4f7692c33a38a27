"""Operators of a training-data pipeline over document and conversation tables.

One module per operator; ``queries`` registers one query for each and its SQL counterpart
where SQL can express it. Nothing else in the library imports this subpackage.
"""
