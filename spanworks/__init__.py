"""DataFrame snapshots, table audits and start-stop episodes on Spark."""
