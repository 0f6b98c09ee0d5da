"""sources of the bar analytics engine."""
