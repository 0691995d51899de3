"""Part of graphquarry."""
