"""Training-data pipeline operators; nothing outside this subpackage imports it."""
