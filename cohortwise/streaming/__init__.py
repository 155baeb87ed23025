"""Reports kept up to date by streams."""
