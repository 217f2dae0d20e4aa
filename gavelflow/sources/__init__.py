"""Reading landed payloads, and publishing results."""
