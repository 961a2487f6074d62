"""Training-data operators: thirteen self-contained jobs over documents, embeddings and conversations.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries only where it can be imported.
"""
