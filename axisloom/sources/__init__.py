"""Tables, run folders and parameter sweeps."""
