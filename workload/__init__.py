"""The registered queries and, next to them, SQL that must give the same rows."""
