"""User-level tables and read-outs composed from the operators."""
