"""Tables, files and services that records come from, and where they go."""
