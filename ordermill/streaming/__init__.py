"""Live orders as a Structured Streaming job."""
