"""permspark: relationship-based permission graphs, evaluated set-at-a-time on Spark."""
