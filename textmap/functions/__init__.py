"""Column-level functions: tokens, codecs, rendering."""
