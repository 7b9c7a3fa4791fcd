"""The registered queries over the driver tables, and their SQL counterparts."""
