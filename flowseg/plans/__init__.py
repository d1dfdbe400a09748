"""Multi-step jobs, and the catalogue of checkable queries."""
