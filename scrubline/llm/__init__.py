"""Operators for training data: ten operators, each in a module of its own, and their queries."""
