"""No operator here works on unbounded input: every one needs a key's complete, ordered values.

Use them inside ``foreachBatch`` for the rows of one micro-batch.
"""
