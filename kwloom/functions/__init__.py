"""Column functions: per-row logic that stays inside the JVM."""
