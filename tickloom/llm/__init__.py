"""Training-data operators over documents, embeddings and conversations.

Nothing outside this package imports it; the driver entry adds its queries
when it is present.
"""
