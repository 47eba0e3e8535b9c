"""The record checks on Structured Streaming inputs."""
