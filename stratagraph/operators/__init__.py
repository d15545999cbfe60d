"""Query operators over nodes, edges, texts, files, commits and memory."""
