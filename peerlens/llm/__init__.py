"""Training-data operators: thirteen operators on documents, conversations and vectors.

Nothing outside this folder imports it. ``catalog`` lists the registered queries and their SQL."""
