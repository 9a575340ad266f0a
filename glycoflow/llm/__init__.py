"""Operators for preparing training text at scale, each with its query and, where SQL can say it, a SQL twin."""
