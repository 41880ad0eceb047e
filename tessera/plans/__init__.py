"""Plans: actions, compiled queries, data changes, stored intermediate results and the query catalogue."""
