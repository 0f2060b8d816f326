"""Column functions with the source warehouse's semantics; every one stays inside codegen-able built-ins."""
