"""Micro-batch entry points of the summariser."""
