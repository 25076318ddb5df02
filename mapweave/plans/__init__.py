"""Named jobs composed from the operators."""
