"""Streaming of finite results: pulling rows from a query partition by partition."""
