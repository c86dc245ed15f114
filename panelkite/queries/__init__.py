"""One query for each operator, and the SQL that it is checked against."""
