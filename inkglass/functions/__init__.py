"""Part of inkglass."""
