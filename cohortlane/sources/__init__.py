"""Reading and writing sample tables, feature matrices and name lists."""
