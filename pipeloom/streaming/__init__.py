"""Pipe queries over Structured Streaming inputs."""
