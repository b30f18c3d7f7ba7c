"""Plan building blocks: skew-safe ordered work and multi-operator jobs."""
