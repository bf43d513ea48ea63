"""Operators of the training-data pipeline that work on texts and pairs. Nothing outside imports this."""
