"""SQL snippets for JSON navigation and the FHIRPath function library."""
