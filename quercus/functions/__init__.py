"""Column functions on names and texts, and maps that go both ways."""
