"""functions of the bar analytics engine."""
