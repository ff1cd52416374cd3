"""Part of skytile."""
