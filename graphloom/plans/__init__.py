"""Named queries over the driver tables, with the SQL that each is checked against."""
