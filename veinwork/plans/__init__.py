"""Registered queries: the operators bound to the dataset's tables, each with its SQL counterpart where SQL can express it."""
