"""Plans: projection, validation and whole runs."""
