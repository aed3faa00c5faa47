"""Training-data operators. Nothing outside this subpackage imports it, so it can be left out whole."""
