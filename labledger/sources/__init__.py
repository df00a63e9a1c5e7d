"""Sources and sinks: the supplied tables, derived fixtures, order snapshots, CSV exports."""
