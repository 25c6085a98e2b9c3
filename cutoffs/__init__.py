"""Disruption analytics over networks, as DataFrame-to-DataFrame operators."""
