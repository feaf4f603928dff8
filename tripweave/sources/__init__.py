"""Reading and writing: manifest paths, files, page text, table sets."""
