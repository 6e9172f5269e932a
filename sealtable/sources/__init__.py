"""Sources and sinks: the catalog of snapshots, JSON dumps, backups."""
