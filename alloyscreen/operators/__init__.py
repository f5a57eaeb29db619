"""Frame-to-frame operators, usable with ``DataFrame.transform``."""
