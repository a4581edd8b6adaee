"""The map-shuffle-reduce API and job arithmetic."""
