"""Operators of a training-data pipeline over ``documents``, ``labels``, ``benchmark`` and ``pages``."""
