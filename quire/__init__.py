"""Document analytics on PySpark: blocks, search, comparison, versions, conversations, layout statistics."""
