"""Analytics over one primary-keyed table whose history is an ordered log of upserts and deletes."""
