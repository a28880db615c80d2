"""Path search and the networks derived from the test tables."""
