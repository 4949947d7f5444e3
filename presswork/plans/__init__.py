"""Multi-step flows, the test-data fixtures and the query registry."""
