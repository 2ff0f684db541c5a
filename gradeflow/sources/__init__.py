"""Reading documents, taxonomies and collections; writing chunks, collections, results and messages."""
