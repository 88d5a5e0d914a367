"""Registered queries of the summariser and their SQL equivalents."""
