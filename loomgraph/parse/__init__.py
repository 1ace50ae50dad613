"""Source files to nodes, edges and marks: a registry of parsers behind one table function."""
