"""DataFrame operators: text, lexical index, vectors, chunks, metadata."""
