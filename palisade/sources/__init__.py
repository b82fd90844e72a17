"""Reading documents from files, converting them, and writing sites."""
