"""Column functions: text, values, sports, places and links."""
