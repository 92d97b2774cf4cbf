"""The registered queries over the generated test tables, with the SQL to compare them to."""
