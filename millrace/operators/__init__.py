"""Exchange operators as DataFrame computations; importing the package registers their queries."""
