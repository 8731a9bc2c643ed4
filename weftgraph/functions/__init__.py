"""Small helpers without operator semantics: scanning, typed literals, row shapes."""
