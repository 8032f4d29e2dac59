"""Log files, and tables in the shared folder."""
