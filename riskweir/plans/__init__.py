"""End-to-end jobs composed from the operators, and the registered queries."""
