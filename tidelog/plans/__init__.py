"""The registered queries and the SQL they must equal."""
