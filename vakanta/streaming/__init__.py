"""The stateless part of the job on a stream of landed files."""
