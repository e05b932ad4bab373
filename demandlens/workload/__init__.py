"""Named queries over the driver tables and their plain-SQL counterparts."""
