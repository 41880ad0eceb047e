"""A PySpark-native relational query engine with a composable, collection-style API."""
