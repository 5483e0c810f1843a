"""Feature, model, statistics and decision operators over bar tables."""
