"""Readers: feeds, route network, schedule, stored stages."""
