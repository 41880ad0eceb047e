"""Sources: declared tables, in-memory and JDBC tables, plain SQL, metadata, models and generated classes."""
