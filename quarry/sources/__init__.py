"""Reading files into tables and writing results."""
