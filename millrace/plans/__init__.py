"""Query registry, SQL front ends and query definitions."""
