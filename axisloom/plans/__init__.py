"""Driver-side plans: index notation, flows, types and runs."""
