"""Column-to-Column scalar functions; everything here stays inside Catalyst."""
