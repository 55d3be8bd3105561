"""Structured Streaming forms of the growing inputs."""
