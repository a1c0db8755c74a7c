"""The registered queries and, for each that SQL can express, the SQL to check it with."""
