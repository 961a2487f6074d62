"""Asset-portfolio analytics on PySpark."""
