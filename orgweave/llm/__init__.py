"""Operators for training-data problems tagged llm; nothing else in the library imports this."""
