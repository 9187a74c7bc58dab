"""Driver-side planning: what every match must contain."""
