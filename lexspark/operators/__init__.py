"""DataFrame operators. Each takes whole tables and returns a lazy DataFrame."""
