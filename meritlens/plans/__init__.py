"""Whole queries: the ranking facade and the registered queries with their SQL."""
