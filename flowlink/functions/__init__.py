"""Column helpers: mapping expressions, hashes, string similarity and wire codecs."""
