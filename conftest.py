"""Makes the repository importable for the tests."""
