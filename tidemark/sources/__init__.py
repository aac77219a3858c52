"""Tables, documents and side inputs: reading, building and writing."""
